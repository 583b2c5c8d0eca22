"""Near-duplicate vectors: random-hyperplane tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from corpusops.llm.components import components, forest
from corpusops.llm.topk import usable
from corpusops.session import stored

#: Vectors in a block; a bucket above it is cut into blocks, and pairs of blocks are compared.
BLOCK = 2048
#: Vectors that a table's bucket should hold, and the share of pairs at the threshold to be found.
BUCKET, RECALL = 64, 0.995


def table_plan(rows: int, threshold: float) -> tuple[int, int]:
    """Bits per table and number of tables, from the largest number of vectors that are compared.

    A pair at the threshold agrees in one bit with p = 1 - angle / pi. The bits keep a bucket of unrelated
    vectors near BUCKET rows at any size, and the tables make 1 - (1 - p ** bits) ** tables reach RECALL.
    """
    bits = min(30, max(6, math.ceil(math.log2(max(rows, 1) / BUCKET + 1))))
    p = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - p**bits))


def _signatures(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits)
        for batch in batches:
            column = batch.column("vector")
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            dims = np.diff(offsets)
            out = np.zeros((batch.num_rows, tables), np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits * tables))
                x = values[offsets[rows][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                out[rows] = ((x @ planes[dim] > 0).reshape(len(rows), tables, bits) * powers).sum(axis=2)
            flat = pa.ListArray.from_arrays(np.arange(0, out.size + 1, tables, dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "signs"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _verify(threshold: float):
    """Links of one pair of blocks: per vector the copies behind its partners, and a spanning forest."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t, low, high = key[-3].as_py(), key[-2].as_py(), key[-1].as_py()
        table = table.combine_chunks()
        ids, copies, block = (table[c].to_numpy() for c in ("rep", "copies", "block"))
        signs = np.stack(table["signs"].to_pylist())
        x = _unit(np.stack(table["vector"].to_numpy(zero_copy_only=False)).astype(np.float64))
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        added = np.zeros(len(ids), np.int64)
        left, right = [], []
        for at in range(0, len(a), 512):
            rows = a[at : at + 512]
            close = x[rows] @ x[b].T >= threshold
            i, j = np.nonzero(close)
            i, j = rows[i], b[j]
            fresh = (i < j) if low == high else np.ones(len(i), bool)
            fresh &= ~(signs[i, :t] == signs[j, :t]).any(axis=1)  # else an earlier table has counted the pair
            i, j = i[fresh], j[fresh]
            np.add.at(added, i, copies[j])
            np.add.at(added, j, copies[i])
            left.append(i)
            right.append(j)
        i, j = (np.concatenate(p) if p else np.empty(0, np.int64) for p in (left, right))
        hit = np.flatnonzero(added)
        root = forest(len(ids), i, j)
        return pa.table({"u": ids[hit], "v": ids[root[hit]], "added": added[hit]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float, seed: int = 7) -> DataFrame:
    """One row per row of ``vectors`` (id: long, vector, label): id, n_links, component_id, kept.

    Two rows link when their labels are equal and not null and their cosine in double precision is at least
    ``threshold``. Equal vectors of one label are collapsed first, so copies are counted, never paired.
    The classes are hashed by the signs of random projections into several tables; classes that share a
    bucket of label, table and signature are candidates, and each candidate pair is verified once, in the
    first table that holds it. A bucket of more than BLOCK classes is cut into blocks that are compared
    pair by pair, so memory is bounded and nothing is dropped. Inside a task the links give a count per class
    and a spanning forest; only those leave it. Found: RECALL of the pairs at the threshold, and more above.

    A vector that is null, empty, all zero, or holds a null or non-finite component, and a row without
    label or id, links with nothing: no links, itself as component, kept. Vectors of different lengths never
    link. Rows that repeat an id count as copies where their vectors are equal.
    """
    good = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vector", "label").withColumn(
        "good", F.coalesce(good & F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    classes = stored(
        rows.where("good").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_plan(most, threshold)
    schema = StructType(list(classes.schema.fields)).add("signs", ArrayType(IntegerType()))
    hashed = classes.mapInArrow(_signatures(bits, tables, seed), schema)
    entries = hashed.select("*", F.posexplode("signs").alias("t", "sign"), F.size("vector").alias("dim"))
    bucket = ["label", "dim", "t", "sign"]
    sizes = entries.groupBy(*bucket).count().where("count > 1").select(*bucket, F.ceil(F.col("count") / BLOCK).alias("blocks"))
    split = entries.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    tiles = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        *bucket, "block", "rep", "copies", "signs", "vector",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    links = stored(
        tiles.groupBy("label", "dim", "sign", "t", "low", "high").applyInArrow(_verify(threshold), "u long, v long, added long"), "links"
    )
    counts = links.groupBy(F.col("u").alias("rep")).agg(F.sum("added").alias("added"))
    roots = components(links).select(F.col("node").alias("rep"), "root")
    known = classes.join(counts, "rep", "left").join(roots, "rep", "left").select(
        F.col("label").alias("c_label"), F.col("vector").alias("c_vector"),
        (F.col("copies") - 1 + F.coalesce("added", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"),
    )
    joined = rows.join(known, F.col("good") & (F.col("label") == F.col("c_label")) & (F.col("vector") == F.col("c_vector")), "left")
    component = F.coalesce("root", "id")
    return joined.select("id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
