"""Evaluation queries: the batch search scored against expectations taken from the query texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.operators import evaluation as ev
from corpusops.operators import golden as gold
from corpusops.operators.hybrid import attach_batch
from corpusops.plans.registry import query
from corpusops.plans.search import batch, batch_sql
from corpusops.plans.sqltext import trim_sql
from corpusops.tables import chunk_view, documents, table

# the weights of the evaluated search
TEXT_ONLY = (0.0, 1.0)

# A query expects chunks holding the first 60 characters of its text, or the chunk that
# carries its own number; every fourth item expects nothing and is not evaluated.
_GOLD = """g AS (SELECT CAST(item_id AS VARCHAR) AS query_id, lower(substring(text, 1, 60)) AS signal, item_id % 4 <> 3 AS evaluated FROM benchmark)"""


def golden(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    asked = F.col("item_id") % 4 != 3
    return table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.lit("docs").alias("domain"),
        F.when(asked, F.array(F.col("item_id").cast("string"))).otherwise(none).alias("expected_chunk_ids"),
        none.alias("expected_source_urls"),
        none.alias("expected_file_paths"),
        F.when(asked, F.array(F.substring("text", 1, 60))).otherwise(none).alias("expected_signals_all"),
        none.alias("expected_signals_any"),
    )


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").count()
    return attach_batch(chunk_view(spark, sf), batch(spark, sf, 10, TEXT_ONLY), asked, 10)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return ev.first_hits(golden(spark, sf), _ranked(spark, sf))


HITS = f"""{batch_sql(10, 0.0, 1.0)}, {_GOLD},
hits AS (SELECT g.query_id, g.evaluated, coalesce(min(CASE WHEN g.evaluated AND
           (res.chunk_id = g.query_id OR contains(lower(c.text), g.signal)) THEN res.rank END), -1) AS first_hit
         FROM g LEFT JOIN res ON res.query_id = g.query_id LEFT JOIN chunks c ON c.chunk_id = res.chunk_id
         GROUP BY g.query_id, g.evaluated)"""
_METRICS = """count(query_id) AS queries, count(*) FILTER (WHERE evaluated) AS evaluated,
  round(coalesce(avg(CASE WHEN evaluated THEN CAST(first_hit BETWEEN 1 AND 3 AS DOUBLE) END), 0), 6) AS recall_at_3,
  round(coalesce(avg(CASE WHEN evaluated THEN CAST(first_hit BETWEEN 1 AND 5 AS DOUBLE) END), 0), 6) AS recall_at_5,
  round(coalesce(avg(CASE WHEN evaluated THEN CASE WHEN first_hit > 0 THEN 1.0 / first_hit ELSE 0 END END), 0), 6) AS mrr_at_10"""


@query("ev_haystack", """
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha1(lower(doc_id || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) ||
  lang || chr(10) || source || chr(10) || chr(10) || text || chr(10) || '{}')) AS haystack_sha1 FROM documents""")
def ev_haystack(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk_view(spark, sf)
    return chunks.select("chunk_id", F.sha1(ev.haystack(chunks)).alias("haystack_sha1"))


@query("ev_match", f"""{batch_sql(10, 0.0, 1.0)}, {_GOLD}
SELECT res.query_id, rank, g.evaluated AND (res.chunk_id = g.query_id OR contains(lower(c.text), g.signal)) AS hit
FROM res JOIN g ON g.query_id = res.query_id JOIN chunks c ON c.chunk_id = res.chunk_id""")
def ev_match(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _ranked(spark, sf)
    none = F.lit(None).cast("string")
    return ranked.withColumn("hay", ev.haystack(ranked)).join(golden(spark, sf).drop("domain"), "query_id").select(
        "query_id", "rank", ev.matches(F.col("hay"), F.col("chunk_id"), none, none).alias("hit")
    )


@query("ev_first_hit", f"{HITS} SELECT query_id, evaluated, CAST(first_hit AS INT) AS first_hit FROM hits")
def ev_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("query_id", "evaluated", "first_hit")


def _round(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.round(c, 6) for c in ("recall_at_3", "recall_at_5", "mrr_at_10") if c in df.columns}
    )


@query("ev_recall", f"{HITS} SELECT evaluated, recall_at_3, recall_at_5 FROM (SELECT {_METRICS} FROM hits)")
def ev_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ev.metrics(_hits(spark, sf))).select("evaluated", "recall_at_3", "recall_at_5")


@query("ev_mrr", f"{HITS} SELECT evaluated, mrr_at_10 FROM (SELECT {_METRICS} FROM hits)")
def ev_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ev.metrics(_hits(spark, sf))).select("evaluated", "mrr_at_10")


@query("ev_by_domain", f"""{HITS}
SELECT 'docs' AS domain, {_METRICS} FROM hits
UNION ALL SELECT 'overall', {_METRICS} FROM hits
UNION ALL SELECT 'lsp', 0, 0, 0, 0, 0""")
def ev_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ev.metrics_by_domain(_hits(spark, sf)))


@query("ev_misses", f"{HITS} SELECT query_id, evaluated FROM hits WHERE NOT first_hit BETWEEN 1 AND 5")
def ev_misses(spark: SparkSession, sf: str) -> DataFrame:
    return ev.misses(_hits(spark, sf)).select("query_id", "evaluated")


@query("ev_percentile", """
WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT max(CASE WHEN i = least(n - 1, floor(0.50 * n)) THEN value END) AS p50,
       max(CASE WHEN i = least(n - 1, floor(0.95 * n)) THEN value END) AS p95,
       max(CASE WHEN i = least(n - 1, floor(1.00 * n)) THEN value END) AS p100 FROM s""")
def ev_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return ev.percentiles(table(spark, sf, "events"), "value", [50, 95, 100])


@query("ev_top_results", f"""{batch_sql(10, 0.0, 1.0)}
SELECT query_id, string_agg(rank || ':' || chunk_id, ',' ORDER BY rank) AS shown FROM res WHERE rank <= 5 GROUP BY query_id""")
def ev_top_results(spark: SparkSession, sf: str) -> DataFrame:
    top = ev.top_results(batch(spark, sf, 10, TEXT_ONLY).select("query_id", "rank", "chunk_id", "score"))
    shown = F.transform("results", lambda r: F.concat_ws(":", r["rank"], r["chunk_id"]))
    return top.select("query_id", F.array_join(shown, ",").alias("shown"))


_FOLD = "trim(regexp_replace(strip_accents(lower(%s)), '[^a-z0-9_./-]+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in gold.STOP_WORDS)


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({_FOLD % x}, ' '), lambda t: length(t) >= 4 AND t NOT IN ({_STOP}))"


@query("gold_rows", """
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, lang AS context, source AS product, CAST(length(text) AS BIGINT) AS n
FROM documents WHERE length(text) >= 220""")
def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    return gold.eligible_docs(titled(spark, sf)).orderBy(*gold.docs_order()).select(
        "chunk_id", "context", "product", F.length("text").cast("long").alias("n")
    )


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with a made-up url shared by ten of them, a title and a heading."""
    d = documents(spark, sf)
    return d.select(
        F.lit("docs").alias("domain"), F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("lang").alias("context"), F.col("source").alias("product"),
        F.concat(F.lit("doc/"), F.floor(F.col("doc_id") / 10)).alias("source_url"),
        F.concat(F.lit("Title "), "doc_id").alias("title"),
        F.concat(F.lit("Docs > "), "lang", F.lit(" > Part "), "doc_id", F.lit(" of "), "source").alias("heading_path"),
        "text",
    )


@query("gold_tokens", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n, sha1(array_to_string(t, ' ')) AS tokens_sha1
FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)""")
def gold_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = documents(spark, sf).select("doc_id", gold.signal_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.sha1(F.array_join("t", " ")).alias("tokens_sha1"))


def signals_cte(key: str, parts: list[str], rows: str) -> str:
    """``sig`` (key, signals): the first three distinct tokens of the joined parts."""
    joined = " || ".join(tokens_sql(p) for p in parts)
    return f"""st AS (SELECT {key}, unnest({joined}) AS t, generate_subscripts({joined}, 1) AS i FROM {rows}),
sf AS (SELECT {key}, t, min(i) AS i FROM st GROUP BY {key}, t),
sr AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) AS k FROM sf),
sig AS (SELECT {key}, string_agg(t, ' ' ORDER BY i) AS signals FROM sr WHERE k <= 3 GROUP BY {key})"""


@query("gold_signals", f"""
WITH {signals_cte('doc_id', ["'part of ' || source", "'Title ' || doc_id", 'text'], 'documents')}
SELECT doc_id, signals FROM sig""")
def gold_signals(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.concat(F.lit("part of "), "source"), F.concat(F.lit("Title "), "doc_id"), F.col("text")]
    return documents(spark, sf).select("doc_id", F.array_join(gold.signals(parts), " ").alias("signals"))


@query("gold_topic", f"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path, url FROM pages),
h AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN replace(path, '/', ' > ') WHEN page_id % 3 = 1 THEN path ELSE '' END AS heading FROM p)
SELECT page_id,
  CASE WHEN contains(heading, '>') THEN {trim_sql("list_filter(list_transform(string_split(heading, '>'), lambda s: trim(s)), lambda s: s <> '')[-1]")}
       WHEN heading <> '' THEN heading ELSE url END AS topic,
  {trim_sql("regexp_replace(regexp_replace(string_split(path, '/')[-1], '(?i)\\.[a-z0-9]+$', ''), '[_-]+', ' ', 'g')")} AS stem
FROM h""")
def gold_topic(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    kind = F.col("page_id") % 3
    heading = F.when(kind == 0, F.replace(path, F.lit("/"), F.lit(" > "))).when(kind == 1, path).otherwise("")
    return table(spark, sf, "pages").select(
        "page_id", gold.heading_topic(heading, F.col("url")).alias("topic"), gold.file_stem(path).alias("stem")
    )


_PICK = """e AS (SELECT *, 'doc/' || CAST(floor(doc_id / 10) AS BIGINT) AS source_url FROM documents WHERE length(text) >= 220),
o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY source, -length(text), CAST(doc_id AS VARCHAR)) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source, -length(text), CAST(doc_id AS VARCHAR), source_url) AS round FROM o),
n AS (SELECT *, row_number() OVER (ORDER BY round, lang) AS n FROM r QUALIFY n <= 40)"""


@query("gold_roundrobin", f"""WITH {_PICK}
SELECT CAST(n AS INT) AS n, CAST(round AS INT) AS round, lang AS context, source_url, CAST(doc_id AS VARCHAR) AS chunk_id FROM n""")
def gold_roundrobin(spark: SparkSession, sf: str) -> DataFrame:
    rows = gold.eligible_docs(titled(spark, sf)).select("source_url", "context", "product", "text", "chunk_id")
    order = [F.col("product"), F.length("text") * -1, F.col("chunk_id")]
    picked = gold.round_robin(rows, F.col("context"), "source_url", 40, order)
    return picked.select("n", "round", "context", "source_url", "chunk_id")


@query("gold_query_text", f"""WITH {_PICK},
q AS (SELECT *, 'Part ' || doc_id || ' of ' || source AS topic, 'Title ' || doc_id AS title FROM n),
{signals_cte('doc_id', ['topic', 'title', 'text'], 'q')}
SELECT 'docs-auto-' || lpad(CAST(n AS VARCHAR), 3, '0') AS id, 'Como configurar ' || topic || ' no ' || source || '?' AS query,
  CASE WHEN n <= 10 THEN 'high' ELSE 'normal' END AS priority, source_url AS expected_source_url,
  signals FROM q JOIN sig USING (doc_id)""")
def gold_query_text(spark: SparkSession, sf: str) -> DataFrame:
    made = gold.docs_questions(titled(spark, sf), 40)
    return made.select(
        "id", "query", "priority", F.get("expected_source_urls", F.lit(0)).alias("expected_source_url"),
        F.array_join("expected_signals_any", " ").alias("signals"),
    )
