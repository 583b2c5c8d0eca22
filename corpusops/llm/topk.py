"""Exact top-k inner-product search by tiles."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a candidate shard and of a query block: a tile's score block has SHARD x BLOCK numbers.
SHARD, BLOCK = 4096, 512
#: Lists merged into one at each level of the tree.
FAN_IN = 16
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def quantised(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component, with x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products; by floating-point matrix product where every sum fits 53 bits."""
    if q.size and c.size and q.shape[1] * float(np.abs(q).max()) * float(np.abs(c).max()) < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _tile(k: int):
    def run(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy()
        ids, keys = table["id"].to_numpy(), table["key"].to_numpy()
        vectors = _matrix(table["vector"])
        order = np.argsort(ids[~is_query], kind="stable")
        c_ids, c = ids[~is_query][order], vectors[~is_query][order]
        q_ids, q_keys, q = ids[is_query], keys[is_query], vectors[is_query]
        out: list[tuple[np.ndarray, ...]] = []
        low = np.iinfo(np.int64).min
        for a in range(0, len(q), BLOCK):
            if not len(c):
                break
            s = _scores(q[a : a + BLOCK], c)
            own = q_ids[a : a + BLOCK, None] == c_ids[None, :]
            s[own] = low
            if len(c) > k:
                floor = np.partition(s, len(c) - k, axis=1)[:, len(c) - k]  # the k-th highest score
                rows, cols = np.nonzero((s >= floor[:, None]) & ~own)
            else:
                rows, cols = np.nonzero(~own)
            picked = s[rows, cols]
            by = np.lexsort((cols, -picked, rows))  # candidates stand in id order, so ties go to the smaller id
            rows, cols, picked = rows[by], cols[by], picked[by]
            first = np.searchsorted(rows, rows)
            keep = np.arange(len(rows)) - first < k
            out.append((q_ids[a : a + BLOCK][rows[keep]], q_keys[a : a + BLOCK][rows[keep]], c_ids[cols[keep]], picked[keep]))
        parts = list(zip(*out)) or [[np.empty(0, np.int64)]] * 4
        names = ("query_id", "query_key", "vec_id", "score")
        return pa.table({n: pa.array(np.concatenate(p).astype(np.int64)) for n, p in zip(names, parts)})

    return run


def top_k(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """The ``k`` highest integer inner products of every query row: query_id, query_key, rank, vec_id, score.

    ``vectors`` has ``id`` (long) and ``vector`` (array of long); ``queries`` marks the query rows. The
    candidates are cut into shards of about SHARD rows, every query is sent to every shard, and a tile
    (one shard against one part of the queries) keeps the k best of each query by partial selection. The
    lists of one query are merged in a tree, FAN_IN lists at a time, so no task sees more than
    FAN_IN * k rows of a query however many shards there are.

    Rows without id or vector take no part. A row with the query's own id is never its candidate, so of
    rows that repeat an id none finds the other. Equal scores go to the smaller id. Two query rows
    with one id and different vectors are told apart by ``query_key``; equal ones count once. Vectors of
    different lengths are never compared.
    """
    base = vectors.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select(
        F.col("id").cast("long").alias("id"),
        "vector",
        F.size("vector").alias("dim"),
        F.coalesce(queries, F.lit(False)).alias("q"),
    )
    total = base.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("long"))).first()
    shards = max(1, -(-total[0] // SHARD))
    blocks = max(1, -(-(total[1] or 0) // (4 * BLOCK)))
    key = F.xxhash64("id", "vector")
    candidates = base.select(
        "id", "vector", "dim", key.alias("key"), F.lit(False).alias("is_query"),
        F.pmod(key, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    asked = base.where("q").dropDuplicates(["id", "vector"]).select(
        "id", "vector", "dim", key.alias("key"), F.lit(True).alias("is_query"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64(F.lit(1), "id", "vector"), F.lit(blocks)).cast("int").alias("block"),
    )
    lists = (
        asked.unionByName(candidates)
        .groupBy("dim", "shard", "block")
        .applyInArrow(_with_shard(k), "query_id long, query_key long, vec_id long, score long, node long")
    )
    left = shards
    while left > 1:
        left = -(-left // FAN_IN)
        lists = _best(lists.withColumn("node", F.expr(f"node div {FAN_IN}")), k, ["query_id", "query_key", "node"]).drop("rank")
    return _best(lists, k, ["query_id", "query_key"]).select("query_id", "query_key", "rank", "vec_id", "score")


def _with_shard(k: int):
    tile = _tile(k)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = tile(table)
        return found.append_column("node", pa.array(np.full(found.num_rows, key[1].as_py(), np.int64)))

    return run


def _best(lists: DataFrame, k: int, by: list[str]) -> DataFrame:
    first = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
