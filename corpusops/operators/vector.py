"""Exact cosine top-k, for one query vector or for a table of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_ROWS = 50_000
TILE_QUERIES = 2_048
#: Scores formed at a time inside a tile (32 MB of them).
SCORE_BLOCK = 1 << 22


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as one float64 matrix; other lengths are cut or zero-padded."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(lists) * dim and lists.null_count == 0:
        counts = np.diff(lists.offsets.to_numpy())
        if (counts == dim).all():
            return np.nan_to_num(flat).reshape(len(lists), dim)
    out = np.zeros((len(lists), dim))
    for i, row in enumerate(lists.to_pylist()):
        kept = [0.0 if x is None else x for x in (row or [])][:dim]
        out[i, : len(kept)] = kept
    return np.nan_to_num(out)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm == 0, 1.0, norm)[:, None]


def cosine_score(vec: Column, query: list[float]) -> Column:
    """max(0, 1 - cosine distance) to one query vector, a whole Arrow batch at a time."""
    q = _unit(np.asarray([query], dtype=np.float64))[0]

    @F.arrow_udf("double")
    def score(lists: pa.Array) -> pa.Array:
        m = _unit(_matrix(lists, len(q)))
        return pa.array(np.maximum(np.einsum("ij,j->i", m, q), 0.0))

    return score(vec)


def vector_topk(chunks: DataFrame, query: list[float], pool: int) -> DataFrame:
    """The ``pool`` nearest chunks; chunks without a vector take no part.

    orderBy + limit keeps ``pool`` rows per task and merges them: no full sort, no shuffle of
    the corpus.
    """
    scored = chunks.filter(F.col("embedding").isNotNull()).select(
        "chunk_id", cosine_score(F.col("embedding"), query).alias("vector_score")
    )
    return scored.orderBy(F.desc("vector_score"), "chunk_id").limit(pool)


def _best(ids: np.ndarray, scores: np.ndarray, pool: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:pool]


class _Tops:
    """Running best ``pool`` (score desc, id asc) of each query over the rows of one task."""

    def __init__(self, n: int, pool: int):
        self.pool = pool
        self.ids = [np.empty(0, dtype=object)] * n
        self.scores = [np.empty(0)] * n

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for q in range(scores.shape[1]):
            col = scores[:, q]
            if len(self.scores[q]) == self.pool:
                keep = col >= self.scores[q][-1]
                if not keep.any():
                    continue
                new_ids, new = ids[keep], col[keep]
            else:
                new_ids, new = ids, col
            all_ids = np.concatenate([self.ids[q], new_ids])
            all_scores = np.concatenate([self.scores[q], new])
            order = _best(all_ids, all_scores, self.pool)
            self.ids[q], self.scores[q] = all_ids[order], all_scores[order]

    def frame(self, query_ids: list) -> pd.DataFrame:
        counts = [len(s) for s in self.scores]
        return pd.DataFrame(
            {
                "query_id": np.repeat(np.asarray(query_ids, dtype=object), counts),
                "chunk_id": np.concatenate(self.ids) if counts else [],
                "vector_score": np.concatenate(self.scores) if counts else [],
            }
        )


def _scores(m: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines, none below 0. A matrix product adds up in an order that depends on the block, so the last digits are
    rounded off: equal vectors tie in every tile."""
    return np.round(np.maximum(m @ queries.T, 0.0), 12)


OUT = "query_id string, chunk_id string, vector_score double"


def _tiled_queries(chunks: DataFrame, queries: DataFrame, pool: int, dim: int, tile_rows: int, tile_queries: int) -> DataFrame:
    """Tiles of bounded size, one per (chunk slice, query block)."""
    n_queries = queries.count()
    slices = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() // tile_rows))
    blocks = max(1, -(-n_queries // tile_queries))
    left = chunks.select(
        "chunk_id", "embedding",
        F.pmod(F.xxhash64("chunk_id"), F.lit(slices)).alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    right = queries.select(
        F.col("query_id").cast("string").alias("query_id"), "embedding",
        F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"),
    )

    def tile(c: pa.Table, q: pa.Table) -> pa.Table:
        ids = q.column("query_id").to_pylist()
        frames = [pd.DataFrame({"query_id": [], "chunk_id": [], "vector_score": []})]
        if c.num_rows and ids:
            names = np.asarray(c.column("chunk_id").to_pylist(), dtype=object)
            m = _unit(_matrix(c.column("embedding").combine_chunks(), dim))
            qs = _unit(_matrix(q.column("embedding").combine_chunks(), dim))
            step = max(1, SCORE_BLOCK // c.num_rows)
            for at in range(0, len(ids), step):
                tops = _Tops(len(ids[at : at + step]), pool)
                tops.add(names, _scores(m, qs[at : at + step]))
                frames.append(tops.frame(ids[at : at + step]))
        frame = pd.concat(frames[1:] or frames, ignore_index=True)
        return pa.Table.from_pandas(
            frame, schema=pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()),
                                     ("vector_score", pa.float64())]), preserve_index=False)

    return (
        left.groupBy("slice", "block")
        .cogroup(right.groupBy("slice", "block"))
        .applyInArrow(tile, OUT)
    )


def vector_topk_batch(chunks: DataFrame, queries: DataFrame, pool: int, dim: int,
                      tile_rows: int = TILE_ROWS, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """The ``pool`` nearest chunks of every query (query_id, embedding); exact.

    Both sides are cut into tiles, so neither the driver nor a task holds them all. A tile forms its
    scores SCORE_BLOCK at a time and keeps only the best of each query.
    """
    chunks = chunks.filter(F.col("embedding").isNotNull())
    queries = queries.filter(F.col("embedding").isNotNull())
    partial = _tiled_queries(chunks, queries, pool, dim, tile_rows, tile_queries)
    w = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), "chunk_id")
    return partial.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= pool).drop("rn")
