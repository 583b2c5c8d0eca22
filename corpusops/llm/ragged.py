"""Rows of different lengths kept in one flat array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0] : starts[0] + lengths[0]], then the next row's part, and so on."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def slices(column: pa.Array, limit: int = 8 << 20) -> Iterator[pa.Array]:
    """A column of texts in runs of rows of about ``limit`` bytes, one row at least; nulls become empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy())
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield column.slice(a, b - a)
        a = b


#: Rows of whole texts that go to a Python worker at once.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session kept to BATCH_ROWS rows: a row is a whole text here."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= BATCH_ROWS:
        df.sparkSession.conf.set(setting, BATCH_ROWS)
    return df


def with_text(docs: DataFrame, carried: list[str], results: tuple[str, ...], *more: Column) -> tuple[DataFrame, list[str]]:
    """The text once, then ``more``, then the columns a result carries (the text among them under its name)."""
    wanted = ["doc_id", *[c for c in carried if c != "doc_id" and c not in results]]
    first = [F.col("text").alias("text" if "text" in wanted else "_text"), *[c.alias(f"_more{i}") for i, c in enumerate(more)]]
    return small_batches(docs).select(*first, *[c for c in wanted if c != "text"]), wanted


def with_results(batch: pa.RecordBatch, names: list[str], *results: pa.Array) -> pa.RecordBatch:
    """The carried columns of a batch from ``with_text`` in the order of ``names``, then the results."""
    by_name = dict(zip(batch.schema.names, batch.columns))
    carried = [by_name[n] for n in names[: len(names) - len(results)]]
    return pa.RecordBatch.from_arrays([*carried, *results], names=names)


def result_schema(rows: DataFrame, **results: str) -> StructType:
    """The schema of ``rows`` and the results behind it, all nullable."""
    schema = StructType([StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    for name, kind in results.items():
        schema = schema.add(name, kind, True)
    return schema


class Memo:
    """Rows of numbers by key, each distinct key worked out once per Python worker; bounded, then it starts anew."""

    def __init__(self, limit: int, dtype: str) -> None:
        self.limit, self.dtype = limit, dtype
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat = np.empty(1 << 20, self.dtype)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def unknown(self, keys: list[str]) -> list[str]:
        return [k for k in keys if k not in self.slots]

    def make_room(self) -> None:
        if len(self.slots) > self.limit:
            self.clear()

    def add(self, keys: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.slots)
        while len(self.starts) < n + len(keys):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.starts[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(keys)] = lengths
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.slots.update(zip(keys, range(n, n + len(keys))))

    def slots_of(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))

    def rows(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the rows in ``slots`` and their numbers, one row after the other."""
        lengths = self.lengths[slots]
        return lengths, gather(self.flat, self.starts[slots], lengths)
