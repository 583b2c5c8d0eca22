"""Embeddings: the deterministic default, shape fixing, batching and usage reports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.functions.text import bind

DIM = 1024
BATCH = 32
#: Batches whose vectors a task holds before it hands them on.
BATCHES_HELD = 8
LOW_RATIO = 0.1

Provider = Callable[[list[str]], list[list[float]]]


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """Value i is byte (i mod 32) of sha256(text), shifted and scaled to [-1, 1)."""
    def of_digest(h: Column) -> Column:
        block = F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: (F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128,
        )
        return F.slice(F.flatten(F.array_repeat(block, -(-dim // 32))), 1, dim)

    return bind(F.sha2(text, 256), of_digest)


def hash_provider(dim: int = DIM) -> Provider:
    """The same values as ``hash_embedding``, as a provider for ``embed_rows``."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            digest = np.frombuffer(hashlib.sha256(t.encode("utf-8")).digest(), dtype=np.uint8)
            out.append(np.resize((digest.astype(np.float64) - 128) / 128, dim).tolist())
        return out

    return embed


def normalize(vec: Column, dim: int = DIM) -> Column:
    """Missing values become 0; cut or zero-padded to the dimension; nothing becomes zeros."""
    given = F.coalesce(vec.cast("array<double>"), F.array().cast("array<double>"))
    filled = F.transform(given, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x))
    return F.slice(F.concat(filled, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def quantize(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.round(x.cast("double"), 8))


def embed_rows(rows: DataFrame, text: str, provider: Provider, dim: int = DIM, batch: int = BATCH,
               out: str = "embedding") -> DataFrame:
    """Embed ``text`` in batches inside the tasks; a blank text gets null.

    Each call of the provider must return one vector per text; anything else fails the task.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            # a frame may hold 10,000 rows; only the vectors of some batches are held at once
            for low in range(0, len(whole), batch * BATCHES_HELD):
                frame = whole.iloc[low : low + batch * BATCHES_HELD]
                texts = frame[text].tolist()
                vectors: list[np.ndarray | None] = [None] * len(texts)
                wanted = [i for i, t in enumerate(texts) if t and t.strip()]
                for at in range(0, len(wanted), batch):
                    part = wanted[at : at + batch]
                    got = provider([texts[i] for i in part])
                    if len(got) != len(part):
                        raise ValueError(f"provider returned {len(got)} vectors for {len(part)} texts")
                    for i, v in zip(part, got):
                        vectors[i] = np.array((list(v) + [0.0] * dim)[:dim], np.float64)
                yield frame.assign(**{out: pd.Series(vectors, index=frame.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def usage(calls: DataFrame, budgets: DataFrame, low_ratio: float = LOW_RATIO) -> DataFrame:
    """Per model and in total: requests, fallbacks, tokens, what is left and whether it is low.

    calls: model, tokens, fallback (boolean). budgets: model, budget (null or 0 = no budget).
    """
    per_model = calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("fallback").alias("fallback_requests"),
        F.sum("tokens").alias("tokens"),
    )
    known = per_model.join(budgets, "model", "left").withColumn(
        "remaining", F.when(F.col("budget") > 0, F.greatest(F.col("budget") - F.col("tokens"), F.lit(0)))
    )
    rolled = known.rollup("model").agg(
        *[F.sum(c).alias(c) for c in ("requests", "fallback_requests", "tokens", "budget", "remaining")],
        F.grouping("model").alias("is_total"),
    )
    one = F.col("is_total") == 0
    ratio = F.when(one & (F.col("budget") > 0), F.col("remaining") / F.col("budget"))
    return rolled.select(
        F.when(one, F.col("model")).otherwise("(total)").alias("model"),
        "requests", "fallback_requests", "tokens",
        F.when(one, F.col("budget")).alias("budget"),
        F.when(one, F.col("remaining")).alias("remaining"),
        ratio.alias("remaining_ratio"),
        F.coalesce(ratio <= low_ratio, F.lit(False)).alias("is_low"),
    )


def rank_models(state: DataFrame, low_ratio: float = LOW_RATIO) -> DataFrame:
    """Order of use: configured order, models low on budget last, unless all of them are low.

    state: model, pos, budget, remaining. One row per configured model.
    """
    low = F.coalesce(F.col("remaining") / F.nullif(F.col("budget"), F.lit(0)) <= low_ratio, F.lit(False))
    flagged = state.withColumn("is_low", low.cast("int"))
    guard = flagged.agg(F.min("is_low").alias("all_low"))
    lookup = flagged.withColumn("all_low", guard.scalar())
    last = F.when(F.col("all_low") == 1, 0).otherwise(F.col("is_low"))
    ranked = lookup.groupBy().agg(
        F.array_sort(F.collect_list(F.struct(last.alias("last"), F.col("pos"), F.col("model"), F.col("is_low")))).alias("m")
    )
    return ranked.select(F.posexplode("m").alias("i", "r")).select(
        (F.col("i") + 1).alias("use_order"), "r.model", F.col("r.is_low").alias("is_low")
    )


def retry_class(status: Column, message: Column) -> Column:
    """What to do after a failed call: stop, or try the next model."""
    m = F.lower(F.coalesce(message, F.lit("")))
    unknown_model = m.contains("not supported") | m.contains("unknown model")
    soft = (
        m.contains("quota") | m.contains("rate limit") | m.contains("capacity")
        | m.contains("temporarily unavailable")
    )
    return (
        F.when(status == 401, "stop")
        .when(status.isin(429, 402, 403) | (status >= 500), "next")
        .when((status == 400) & unknown_model, "next")
        .when(soft, "next")
        .otherwise("stop")
    )
