"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.llm import (
    bpe, embed_dedup, exchange, langid, lm_scoring, ngram_join, packing, periodic_runs, quality, resampling, sharding, substring_dedup,
    suffix_dedup, topk,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op3_exact_topk", _OP3)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vector")
    )
    return topk.top_k(vectors, F.col("id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score")


@query("op5_sharding")
def byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of near equal bytes; equal texts stand next to each other in the shard order."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    order = [F.col("text_hash"), F.col("size"), F.col("doc_id")]
    return sharding.shard_by_bytes(rows, F.col("size"), order, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op6_packing")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return packing.pack(pieces, 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_embedding_dedup")
def embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return embed_dedup.near_duplicates(vectors, 0.93).withColumnRenamed("id", "vec_id")


@query("op8_bpe")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; a null doc_id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(0))


@query("op2_language_id")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs, fold(4) != 2))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op7_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    positives = read(spark, sf_dir, "labels").where("quality = 1")
    found = quality.score(docs, quality.train(docs, positives, fold(5) != 0))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_ngram_join")
def shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), 5, 80)


@query("op1_suffix_dedup")
def suffix_dedup_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), 50)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def learns(ids: np.ndarray) -> np.ndarray:
    """The same fold as ``fold(7) != 2``."""
    return np.fromiter((zlib.crc32(str(i).encode()) % 7 != 2 for i in ids.tolist()), bool, len(ids)) | (ids == exchange.LAST_ID)


@query("op9_lm_scoring")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score(read(spark, sf_dir, "documents"), learns)
    return found.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_substring_dedup")
def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), 20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP12 = """
WITH RECURSIVE divided AS (SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c, 0 AS step FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM divided WHERE step < 8),
bytewise AS (SELECT list(c ORDER BY i) AS t FROM divided WHERE step = 8),
words AS (
  SELECT 's' AS side, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 't', NULL, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
spelled AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM words),
hashed AS (
  SELECT w, xor(list_reduce(
    list_transform(range(0, CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM spelled, bytewise),
counted AS (
  SELECT bucket, CAST(count(*) FILTER (side = 's') AS BIGINT) AS s, CAST(count(*) FILTER (side = 't') AS BIGINT) AS t
  FROM words JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT sum(s) AS sa, sum(t) AS ta FROM counted),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sa + 10000) AS DOUBLE) / CAST((s + 1) * (ta + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM counted, totals),
weights AS (
  SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 's' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5)
      / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, s.weight, s.score,
  CAST(CASE WHEN r <= 10 * n // 100 THEN r END AS BIGINT) AS rank
FROM scored s LEFT JOIN placed p USING (doc_id)
"""


@query("op12_resampling", _OP12)
def target_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 1, 10_000, 10, 20, 2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the periodic tails that the contract of op13 plants; a null doc_id gets none."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))  # of a tenth of the rows
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    begin = g % n
    period = 1 + F.floor((n - begin) / (3 + g % 8))
    planted = F.array_join(periodic_runs.repeated_tail(F.col("words"), F.col("begin"), F.col("period")), " ")
    return rows.withColumn("begin", begin).withColumn("period", period).select(
        "doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text")
    )


@query("op13_periodic_runs")
def periodic_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_tails(read(spark, sf_dir, "documents")), 24, 3)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("strongest.start").alias("start"),
        F.col("strongest.length").alias("length"),
        F.col("strongest.period").alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
