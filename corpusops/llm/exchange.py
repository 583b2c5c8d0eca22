"""Questions that slices of a corpus put to the whole of it.

Documents are dealt into slices by hash. A slice sends each of its distinct 64-bit keys once, whatever number
of its documents hold it, to the part of the key space that the key's leading bits name, and gets one answer
per key back. So a key that every document holds costs one entry per slice, parts stay even, and neither
a slice nor a part grows with the corpus: their numbers do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.llm.ragged import small_batches

#: Bytes of text in a slice, and bytes of text behind the keys of one part.
SLICE, PART = 3 << 20, 4 << 20
LAST_ID = np.iinfo(np.int64).max

ASK = "slice long, part int, keys binary, extra binary"
ANSWER = "slice long, part int, found binary"


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and each key's place among them."""
    coded = pa.array(keys).dictionary_encode()
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[coded.indices.to_numpy()]


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``distinct`` gives, by one sort: cheaper where most keys come once."""
    order = np.argsort(keys)
    values = keys[order]
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return values[new], place


def leading(keys: np.ndarray, total: int, spare: int) -> np.ndarray:
    """The leading bits of keys, ``spare`` more than it takes to number ``total`` things, in whole bytes."""
    bits = min(64, -(-(int(total).bit_length() + spare) // 8) * 8)
    return keys & ~np.uint64((1 << (64 - bits)) - 1)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in as few bytes each as the largest needs; common low zero bits are left out."""
    if not len(keys):
        return b""
    unused = 0
    while unused < 56 and not (keys & np.uint64((256 << unused) - 1)).any():
        unused += 8
    keys = keys >> np.uint64(unused)
    steps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    narrow = steps.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width, unused]) + keys[:1].tobytes() + narrow.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width, unused = data[:2]
    narrow = np.frombuffer(data, np.uint8, -1, 10).reshape(-1, width)
    steps = np.zeros((len(narrow), 8), np.uint8)
    steps[:, :width] = narrow
    first = np.frombuffer(data, np.uint64, 1, 2)[0]
    return (np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) + first) << np.uint64(unused)


class Corpus:
    """The slices of a table, dealt by ``key``, and the number of parts that fits the bytes of its ``content``."""

    def __init__(self, rows: DataFrame, key: str, content: str, slice_bytes: int = SLICE, part_bytes: int = PART) -> None:
        self.total = small_batches(rows).agg(F.sum(F.octet_length(content).cast("long"))).first()[0] or 0
        self.slices = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-self.total // slice_bytes))
        self.bits = max(3, int(-(-self.total // part_bytes)).bit_length())
        self.rows = rows.withColumn("slice", F.pmod(F.xxhash64(key, F.octet_length(content)), F.lit(self.slices)))

    @classmethod
    def of_texts(cls, docs: DataFrame, carried: list[str] = (), together: int = 0, **sizes: int) -> Corpus:
        """Of doc_id and text, packed; ``documents`` unpacks a slice, and ``others`` the columns ``carried`` along.

        Every batch of the scan sends one compressed row to each slice, so texts cross the network once at a
        fraction of their size, and a slice of many short texts is few rows. Batches of a task go ``together`` up to
        that many bytes, so that rows stay long where there are many slices.
        """
        along = F.struct(*carried) if carried else F.lit(None).cast("struct<none: int>")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), along.alias("along"))
        out = cls(rows, "doc_id", "text", **sizes)
        out.rows = out.rows.mapInArrow(lambda batches: _packed(batches, together), "slice long, n int, size long, packed binary, along binary")
        return out

    def ask(self, rows: DataFrame, keys_of: Callable, answers: DataFrame | None = None) -> DataFrame:
        """ASK rows. ``keys_of`` gets a slice's table (and the answers it has got so far) and gives sorted
        distinct keys and an array of what goes with each."""
        bits = self.bits

        def run(key: tuple, table: pa.Table, known: pa.Table | None = None) -> pa.Table:
            keys, extra = keys_of(table) if known is None else keys_of(table, known)
            bounds = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(bounds))
            cuts = [(bounds[p], bounds[p + 1]) for p in full]
            return pa.table({
                "slice": pa.array([key[0].as_py()] * len(full), pa.int64()),
                "part": pa.array(full.astype(np.int32)),
                "keys": pa.array([pack(keys[a:b]) for a, b in cuts], pa.binary()),
                "extra": pa.array([to_bytes(extra[a:b]) for a, b in cuts], pa.binary()),
            })

        grouped = rows.groupBy("slice")
        if answers is None:
            return grouped.applyInArrow(lambda key, table: run(key, table), ASK)
        return grouped.cogroup(answers.groupBy("slice")).applyInArrow(run, ASK)

    def answer(self, asks: DataFrame, found_for: Callable, extra_type: str, number: Callable = distinct) -> DataFrame:
        """ANSWER rows. ``found_for`` gets all entries of a part (the distinct keys, each entry's place among
        them, both as ``number`` finds them, and what goes with it) and gives one number per entry."""

        def run(table: pa.Table) -> pa.Table:
            keys = [unpack(k) for k in table["keys"].to_pylist()]
            extra = np.concatenate([from_bytes(e, extra_type, len(k)) for e, k in zip(table["extra"].to_pylist(), keys)])
            values, place = number(np.concatenate(keys))
            answers = np.split(found_for(values, place, extra), np.cumsum([len(k) for k in keys])[:-1])
            return pa.table({
                "slice": table["slice"], "part": table["part"],
                "found": pa.array([framed(f) for f in answers], pa.binary()),
            })

        return asks.groupBy("part").applyInArrow(run, ANSWER)


def to_bytes(x: np.ndarray) -> bytes:
    """Booleans as bits, 64-bit numbers as differences from the smallest in as few bytes as needed."""
    if x.dtype == bool:
        return np.packbits(x).tobytes()
    if x.dtype != np.int64 or not len(x):
        return x.tobytes()
    low = x.min()
    above = x.view(np.uint64) - low.view(np.uint64)
    width = max(1, (int(above.max()).bit_length() + 7) // 8)
    return bytes([width]) + low.tobytes() + above.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_bytes(data: bytes, kind: str, n: int) -> np.ndarray:
    if kind == "?":
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
    if kind != "<i8" or not n:
        return np.frombuffer(data, kind)
    above = np.zeros((n, 8), np.uint8)
    above[:, : data[0]] = np.frombuffer(data, np.uint8, -1, 9).reshape(n, -1)
    return (above.view(np.uint64).ravel() + np.frombuffer(data, np.uint64, 1, 1)).view(np.int64)


def framed(x: np.ndarray) -> bytes:
    return len(x).to_bytes(4, "little") + to_bytes(x)


def found(answers: pa.Table, kind: str) -> np.ndarray:
    """The answers of a slice in the order of its keys."""
    order = np.argsort(answers["part"].to_numpy())
    column = answers["found"].to_pylist()
    parts = [from_bytes(column[i][4:], kind, int.from_bytes(column[i][:4], "little")) for i in order]
    return np.concatenate(parts) if parts else np.empty(0, np.dtype(kind))


def in_two(values: np.ndarray, place: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Whether a key is in two documents or more; ``several`` says that a slice has it in more than one."""
    times = np.bincount(place, weights=1 + several.astype(np.int64), minlength=len(values))
    return (times > 1)[place]


def earlier(values: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether another slice holds the key in a document before the slice's own ``first``."""
    lowest = np.full(len(values), LAST_ID)
    np.minimum.at(lowest, place, first)
    return first > lowest[place]


def summed(values: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.bincount(place, weights=count, minlength=len(values)).astype(np.int64)[place]


def _gathered(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.Table]:
    """Tables of several batches with rows in them, each up to ``together`` bytes, but of one batch at least."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > together:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _packed(batches: Iterator[pa.RecordBatch], together: int = 0) -> Iterator[pa.RecordBatch]:
    for table in _gathered(batches, together):
        rows = table.sort_by("slice").combine_chunks()
        ids = pc.fill_null(rows["doc_id"], LAST_ID).to_numpy()
        offsets, data = _bytes(rows["text"])
        slices, first = np.unique(rows["slice"].to_numpy(), return_index=True)
        out = []
        for a, b in zip(first, np.append(first[1:], len(ids))):
            content = ids[a:b].tobytes() + np.diff(offsets[a : b + 1]).tobytes() + data[offsets[a] : offsets[b]].tobytes()
            sink = pa.BufferOutputStream()
            along = rows.slice(a, b - a).select(["along"])
            if along["along"].null_count < len(along):
                with pa.ipc.new_stream(sink, along.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(along)
            out.append((b - a, len(content), pa.compress(content, "zstd", asbytes=True), sink.getvalue().to_pybytes()))
        n, size, packed, others = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slices), pa.array(n, pa.int32()), pa.array(size, pa.int64()), pa.array(packed, pa.binary()), pa.array(others, pa.binary())],
            names=["slice", "n", "size", "packed", "along"],
        )


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts; a null text counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return bounds - bounds[0], np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]


def documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and bytes of the texts of a slice, ordered by id and, where ids repeat, by text.

    A null id counts as the largest, a null text as empty.
    """
    return _unpacked(table)[:3]


def others(table: pa.Table) -> pa.Table:
    """The columns carried along, in the order of ``documents``."""
    parts = [pa.ipc.open_stream(x).read_all() for x in table["along"].to_pylist()]
    return pa.Table.from_struct_array(pa.concat_tables(parts)["along"].combine_chunks()).take(_unpacked(table)[3])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pa.default_memory_pool().release_unused()  # of the group before
    ids, lengths, texts = [], [], []
    for n, size, packed in zip(*(table[c].to_pylist() for c in ("n", "size", "packed"))):
        content = np.frombuffer(pa.decompress(packed, size, "zstd"), np.uint8)
        ids.append(content[: 8 * n].view(np.int64))
        lengths.append(content[8 * n : 16 * n].view(np.int64))
        texts.append(content[16 * n :])
    if not ids:
        return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint8), np.empty(0, np.int64)
    ids, lengths, data = (np.concatenate(x) for x in (ids, lengths, texts))
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], data[starts[i] : starts[i] + lengths[i]].tobytes())))
    offsets = np.concatenate([[0], np.cumsum(lengths[order])])
    return ids[order], offsets, np.concatenate([data[starts[i] : starts[i] + lengths[i]] for i in order.tolist()]), order


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == LAST_ID)
