"""Hybrid search: two bounded candidate pools, one weighted score, late payload."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.operators.lexical import BROADCAST_ROWS, text_topk, text_topk_batch
from corpusops.operators.postings import WordIndex, index_matches
from corpusops.operators.vector import vector_topk, vector_topk_batch

DEFAULT_TOP_K = 8
MAX_TOP_K = 30
DEFAULT_POOL = 80
MAX_POOL = 500

# Vector and text weight of each domain.
WEIGHTS = {"docs": (0.75, 0.25), "lsp": (0.65, 0.35)}


@dataclass(frozen=True)
class Filters:
    context: str | None = None
    product: str | None = None
    version: str | None = None
    module: str | None = None
    routine_name: str | None = None

    def predicate(self, domain: str) -> Column:
        """Only the filters that are set reach the plan; null and '' mean no filter."""
        p = F.col("domain") == domain
        for name, value in vars(self).items():
            if value:
                p = p & (F.col(name) == value)
        return p


def clamp_top_k(k: int | None) -> int:
    return min(MAX_TOP_K, max(1, DEFAULT_TOP_K if k is None else int(k)))


def pool_size(top_k: int, pool: int | None = None) -> int:
    return max(top_k, min(MAX_POOL, max(1, DEFAULT_POOL if pool is None else int(pool))))


def _number(value) -> float | None:
    try:
        return float(value) if str(value).strip() != "" else None
    except (TypeError, ValueError):
        return None


def weights(domain: str, settings: dict[str, str] | None = None) -> tuple[float, float]:
    """Weights of a domain: its own setting, then the general one, then the defaults.

    Setting names are WEIGHT_VECTOR_DOCS, WEIGHT_TEXT_LSP and so on, WEIGHT_VECTOR and
    WEIGHT_TEXT for all domains. An empty setting counts as unset.
    """
    given = settings if settings is not None else dict(os.environ)
    out = []
    for kind, default in zip(("VECTOR", "TEXT"), WEIGHTS[domain]):
        own = _number(given.get(f"WEIGHT_{kind}_{domain.upper()}"))
        general = _number(given.get(f"WEIGHT_{kind}"))
        out.append(own if own is not None else general if general is not None else default)
    return out[0], out[1]


def merge_max(candidates: DataFrame, *key: str) -> DataFrame:
    return candidates.groupBy(*key).agg(
        F.max("vector_score").alias("vector_score"), F.max("text_score").alias("text_score")
    )


def candidates(vector: DataFrame, text: DataFrame) -> DataFrame:
    return vector.withColumn("text_score", F.lit(0.0)).unionByName(
        text.withColumn("vector_score", F.lit(0.0))
    )


def _weighted(wv: float, wt: float) -> Column:
    return F.lit(wv) * F.col("vector_score") + F.lit(wt) * F.col("text_score")


RANKING = ("score", "vector_score", "text_score")


def _ranking() -> list[Column]:
    return [F.desc(c) for c in RANKING] + [F.asc("chunk_id")]


def rank_one(candidates: DataFrame, top_k: int, wv: float, wt: float) -> DataFrame:
    merged = merge_max(candidates, "chunk_id").withColumn("score", _weighted(wv, wt))
    return merged.orderBy(*_ranking()).limit(top_k)


def attach(chunks: DataFrame, ranked: DataFrame) -> DataFrame:
    """Payload for the ranked keys; at most MAX_TOP_K keys, so their side is broadcast."""
    return chunks.join(F.broadcast(ranked), "chunk_id")


def attach_batch(chunks: DataFrame, ranked: DataFrame, n_queries: int, top_k: int) -> DataFrame:
    """Payload for the ranked keys of a batch, at most ``n_queries * top_k`` rows: broadcast while
    that is few, so that texts are not shuffled to meet a short list."""
    few = n_queries * clamp_top_k(top_k) <= BROADCAST_ROWS
    return chunks.join(F.broadcast(ranked) if few else ranked, "chunk_id")


def _vectors_of(mine: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Vectors of the filtered chunks: a column of theirs, or a table of its own by chunk_id."""
    if vectors is None:
        return mine.select("chunk_id", "embedding")
    return vectors.join(mine.select("chunk_id"), "chunk_id", "left_semi")


def hybrid_search(chunks: DataFrame, query: str, query_vector: list[float] | None, domain: str = "docs",
                  filters: Filters = Filters(), top_k: int | None = None, pool: int | None = None,
                  weight: tuple[float, float] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Top-k chunks for one query. Without a query vector only the text score counts."""
    k = clamp_top_k(top_k)
    size = pool_size(k, pool)
    wv, wt = weight or weights(domain)
    mine = chunks.filter(filters.predicate(domain))
    if not query.strip():
        mine = mine.limit(0)
    text = text_topk(mine, query, size)
    if query_vector is None:
        ranked = text.select(
            "chunk_id", F.lit(0.0).alias("vector_score"), "text_score", F.col("text_score").alias("score")
        ).orderBy(*_ranking()).limit(k)
    else:
        ranked = rank_one(
            candidates(vector_topk(_vectors_of(mine, vectors), query_vector, size), text), k, wv, wt
        )
    payload = mine.drop("embedding")
    return attach(payload, ranked).orderBy(*_ranking())


def hybrid_search_batch(chunks: DataFrame, queries: DataFrame, dim: int, domain: str = "docs",
                        filters: Filters = Filters(), top_k: int | None = None, pool: int | None = None,
                        weight: tuple[float, float] | None = None,
                        vectors: DataFrame | None = None, index: WordIndex | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, scores) for a table of queries (query_id, text, embedding).

    ``chunks`` needs chunk_id and text, and embedding unless ``vectors`` are given. With a stored word ``index`` of the
    chunks no text is read. Texts and payloads are joined by the caller once the ranking is down to top_k rows per query.
    """
    k = clamp_top_k(top_k)
    size = pool_size(k, pool)
    wv, wt = weight or weights(domain)
    mine = chunks.filter(filters.predicate(domain))
    asked = queries.filter(F.trim("text") != "")
    matched = None if index is None else index_matches(index, asked, mine)
    both = candidates(
        vector_topk_batch(_vectors_of(mine, vectors), asked, size, dim), text_topk_batch(mine, asked, size, matched)
    )
    scored = merge_max(both, "query_id", "chunk_id").withColumn("score", _weighted(wv, wt))
    w = Window.partitionBy("query_id").orderBy(*_ranking())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
