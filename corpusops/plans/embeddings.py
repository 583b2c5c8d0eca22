"""Embedding queries over documents, vectors and a call log made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.operators import embeddings as emb
from corpusops.plans.registry import query
from corpusops.tables import documents, table


def hash_sql(text: str, dim: int) -> str:
    return (
        f"list_transform(range(0, {dim}), lambda i: "
        f"(CAST('0x' || substring(sha256({text}), 2 * (i % 32) + 1, 2) AS INT) - 128) / 128.0)"
    )


# position-weighted sum: one number that depends on every value and its place
def weighted(vec: str) -> str:
    return f"list_sum(list_transform({vec}, lambda x, i: x * (i % 97 + 1)))"


def _weighted(vec):
    return F.aggregate(
        F.transform(vec, lambda x, i: x * ((i + 1) % 97 + 1)), F.lit(0.0), lambda a, x: a + x
    )


_HASHED = f"""
WITH e AS (SELECT doc_id, list_transform({hash_sql('text', 1024)}, lambda x: CAST(x AS DOUBLE)) AS v FROM documents)
SELECT doc_id, CAST(len(v) AS BIGINT) AS dim, v[1] AS first_value, v[1024] AS last_value,
       round({weighted('v')}, 6) AS checksum FROM e"""


@query("emb_hash", _HASHED)
def emb_hash(spark: SparkSession, sf: str) -> DataFrame:
    e = documents(spark, sf).select("doc_id", emb.hash_embedding(F.col("text")).alias("v"))
    return _summary(e)


def _summary(e: DataFrame) -> DataFrame:
    return e.select(
        "doc_id", F.size("v").cast("long").alias("dim"), F.get("v", F.lit(0)).alias("first_value"),
        F.element_at("v", -1).alias("last_value"), F.round(_weighted(F.col("v")), 6).alias("checksum"),
    )


@query("emb_batch", _HASHED)
def emb_batch(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return _summary(emb.embed_rows(docs, "text", emb.hash_provider(), out="v"))


@query("emb_normalize", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i % 10 = 0 THEN NULL ELSE CAST(x AS DOUBLE) END) AS raw FROM embeddings),
n AS (SELECT vec_id, list_transform(range(1, 81), lambda i: coalesce(raw[i], 0.0)) AS wide,
             list_transform(range(1, 33), lambda i: coalesce(raw[i], 0.0)) AS narrow FROM v)
SELECT vec_id, CAST(len(wide) AS BIGINT) AS wide_dim, CAST(len(narrow) AS BIGINT) AS narrow_dim,
       round(list_sum(list_transform(wide, lambda x, i: x * i)), 6) AS wide_sum,
       round(list_sum(list_transform(narrow, lambda x, i: x * i)), 6) AS narrow_sum FROM n""")
def emb_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.transform("embedding", lambda x, i: F.when((i + 1) % 10 != 0, x.cast("double")))
    n = table(spark, sf, "embeddings").select(
        "vec_id", emb.normalize(raw, 80).alias("wide"), emb.normalize(raw, 32).alias("narrow")
    )

    def placed(name: str):
        return F.round(F.aggregate(F.transform(name, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6)

    return n.select(
        "vec_id", F.size("wide").cast("long").alias("wide_dim"),
        F.size("narrow").cast("long").alias("narrow_dim"),
        placed("wide").alias("wide_sum"), placed("narrow").alias("narrow_sum"),
    )


@query("emb_quantize", """
SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100000000) AS BIGINT))) AS value_e8,
       CAST(generate_subscripts(embedding, 1) AS BIGINT) AS pos FROM embeddings""")
def emb_quantize(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", F.posexplode(emb.quantize(F.col("embedding"))).alias("i", "x"))
    return v.select(
        "vec_id", F.round(F.col("x") * 100000000).cast("long").alias("value_e8"),
        (F.col("i") + 1).cast("long").alias("pos"),
    )


@query("emb_tokens", """
SELECT lang, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY lang""")
def emb_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).groupBy("lang").agg(
        F.sum(emb.token_estimate(F.col("text"))).alias("tokens")
    )


BUDGETS = {"view": 100_000, "click": 60_000, "error": 55_000, "signup": 0}
ORDER = ["view", "click", "error", "signup", "purchase"]
_BUDGET_ROWS = ", ".join(f"('{m}', {b})" for m, b in BUDGETS.items())


def _budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUDGETS.items()), "model string, budget bigint")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as embedding calls: type is the model, value the tokens, large k a fallback."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.ceil("value").alias("tokens"), (k >= 90).alias("fallback")
    )


_USAGE = f"""budgets(model, budget) AS (VALUES {_BUDGET_ROWS}),
m AS (SELECT event_type AS model, count(*) AS requests,
             count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS INT) >= 90) AS fallback_requests,
             CAST(sum(ceil(value)) AS BIGINT) AS tokens FROM events GROUP BY event_type),
u AS (SELECT m.*, CAST(b.budget AS BIGINT) AS budget,
             CASE WHEN b.budget > 0 THEN CAST(greatest(b.budget - tokens, 0) AS BIGINT) END AS remaining
      FROM m LEFT JOIN budgets b USING (model))"""


@query("emb_usage", f"""
WITH {_USAGE}
SELECT model, requests, fallback_requests, tokens, budget, remaining,
       CASE WHEN budget > 0 THEN round(remaining / budget, 6) END AS remaining_ratio,
       coalesce(budget > 0 AND remaining / nullif(budget, 0) <= 0.1, false) AS is_low FROM u
UNION ALL
SELECT '(total)', CAST(sum(requests) AS BIGINT), CAST(sum(fallback_requests) AS BIGINT), CAST(sum(tokens) AS BIGINT),
       NULL, NULL, NULL, false FROM u""")
def emb_usage(spark: SparkSession, sf: str) -> DataFrame:
    u = emb.usage(_calls(spark, sf), _budgets(spark))
    return u.withColumn("remaining_ratio", F.round("remaining_ratio", 6))


@query("emb_budget_rank", f"""
WITH {_USAGE},
o(model, pos) AS (VALUES {", ".join(f"('{m}', {i})" for i, m in enumerate(ORDER))}),
l AS (SELECT u.model, pos, CAST(coalesce(remaining / nullif(budget, 0) <= 0.1, false) AS INT) AS is_low FROM u JOIN o USING (model))
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN (SELECT min(is_low) FROM l) = 1 THEN 0 ELSE is_low END, pos) AS INT) AS use_order,
       model, is_low FROM l""")
def emb_budget_rank(spark: SparkSession, sf: str) -> DataFrame:
    used = emb.usage(_calls(spark, sf), _budgets(spark)).filter(F.col("model") != "(total)")
    pos = F.array_position(F.lit(ORDER), F.col("model"))
    return emb.rank_models(used.withColumn("pos", pos))


_STATUS = """CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 401 WHEN 'click' THEN 429 WHEN 'purchase' THEN 400 ELSE 404 END"""
_MESSAGE = """CASE WHEN k < 20 THEN 'Unknown model x' WHEN k < 40 THEN 'Rate limit reached' WHEN k < 60 THEN 'Not supported' ELSE 'bad input' END"""


@query("emb_retry_class", f"""
WITH c AS (SELECT event_id, {_STATUS} AS status, lower({_MESSAGE}) AS m
           FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)),
d AS (SELECT *, CASE WHEN status = 401 THEN 'stop' WHEN status IN (429, 402, 403) OR status >= 500 THEN 'next'
       WHEN status = 400 AND (contains(m, 'not supported') OR contains(m, 'unknown model')) THEN 'next'
       WHEN contains(m, 'quota') OR contains(m, 'rate limit') OR contains(m, 'capacity') OR contains(m, 'temporarily unavailable') THEN 'next'
       ELSE 'stop' END AS action FROM c)
SELECT event_id, action FROM d""")
def emb_retry_class(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").select(
        "event_id", F.expr(_STATUS).alias("status"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    return calls.select("event_id", emb.retry_class(F.col("status"), F.expr(_MESSAGE)).alias("action"))
