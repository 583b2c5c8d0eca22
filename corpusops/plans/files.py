"""Source and sink queries: given tables written in a file format and read back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.operators import evaluation as ev
from corpusops.operators import buckets, ingest, merge
from corpusops.plans.evaluation import HITS, _METRICS, _hits, _round
from corpusops.plans.ingest import doc_lines
from corpusops.plans.models import model_columns
from corpusops.plans.registry import query
from corpusops.plans.sqltext import clean_sql
from corpusops.session import scratch_dir
from corpusops.sources import files, sinks
from corpusops.tables import documents, table

CLEAN = clean_sql("text")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("src_jsonl", f"""
SELECT 'doc/' || source || '/' || doc_id AS source_url, sha1({CLEAN}) AS text_sha1,
  CASE WHEN lang = 'fr' THEN 'error' WHEN length({CLEAN}) < 50 THEN 'skipped' ELSE 'ready' END AS status FROM documents WHERE lang <> 'fr'
UNION ALL SELECT NULL, sha1(''), 'error' FROM documents WHERE lang = 'fr'""")
def src_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as JSON lines, blank lines between them, French lines cut off in the middle."""
    path = _fresh(spark, "jsonl")
    lines = doc_lines(documents(spark, sf)).drop("_corrupt_record", "input_pos")
    as_json = F.to_json(F.struct(*lines.columns))
    broken = F.when(F.col("context") == "fr", F.substr(as_json, F.lit(1), F.length(as_json) - 5)).otherwise(as_json)
    lines.select(F.concat(broken, F.lit("\n")).alias("value")).write.text(path)
    status = ingest.doc_status(files.read_doc_lines(spark, [path]))
    bad = F.col("status") == "error"
    return status.select(
        F.when(~bad, F.col("source_url")).alias("source_url"),
        F.sha1(F.when(bad, "").otherwise(F.col("text"))).alias("text_sha1"), "status",
    )


@query("src_tree", """
SELECT lang, source, CAST(count(*) AS BIGINT) AS documents FROM documents WHERE lang <> 'fr' AND source <> 'src7' GROUP BY lang, source""")
def src_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files in folders by language and source; two folders are skipped."""
    path = _fresh(spark, "tree")
    one_line = F.regexp_replace("text", r"[\r\n\x00]", " ")
    documents(spark, sf).select("lang", "source", one_line.alias("value")).write.partitionBy("lang", "source").text(path)
    tree = files.read_tree(spark, [path], ["LANG=FR", "source=src7"])
    lines = F.size(F.split(F.rtrim(files.decode(F.col("content")), F.lit("\n")), "\n", -1))
    return tree.select(
        F.regexp_extract("path", "/lang=([^/]+)/", 1).alias("lang"),
        F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"), lines.alias("n"),
    ).groupBy("lang", "source").agg(F.sum("n").alias("documents"))


@query("src_decode", """
SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE sha1(text) END AS text_sha1 FROM documents""")
def src_decode(spark: SparkSession, sf: str) -> DataFrame:
    """German texts carry a NUL and are refused."""
    marked = F.when(F.col("lang") == "de", F.concat("text", F.lit("\x00"))).otherwise(F.col("text"))
    return documents(spark, sf).select("doc_id", F.sha1(files.decode(F.encode(marked, "UTF-8"))).alias("text_sha1"))


@query("src_delim_sniff", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def src_delim_sniff(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark, "sample")
    sinks.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return files.read_sample(spark, path)


@query("src_models", """
SELECT '01-' || source || '_' || lang || doc_id || '.json' AS filename, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_bands,
  CAST(list_sum(list_transform(string_split(text, chr(10)), lambda l: len(list_filter(string_split(l, ' '), lambda w: w <> '')))) AS BIGINT) AS n_children
FROM documents""")
def src_models(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as models, some fifty to a file as one JSON array, read back file by file.

    What is shuffled is the documents; they become models, many times their size, beside the file that is written.
    """
    path = _fresh(spark, "models")
    docs = documents(spark, sf).select("doc_id", "source", "lang", "text")
    filename = model_columns(F.col)[0]
    per_file = F.pmod(F.xxhash64(filename), F.lit(max(1, docs.count() // 50)))
    together = docs.groupBy(per_file.alias("file")).agg(F.collect_list(F.struct(*docs.columns)).alias("docs"))
    models = F.transform("docs", lambda d: F.struct(*model_columns(lambda name: d[name])))
    written = together.select(F.to_json(models).alias("value")).write
    written.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    models = files.read_models(spark, path)
    children = F.aggregate("bands", F.lit(0), lambda a, b: a + F.size(b["children"]))
    return models.select(
        "filename", F.size("bands").cast("long").alias("n_bands"), children.cast("long").alias("n_children")
    )


@query("src_golden", """
SELECT CAST(item_id AS VARCHAR) AS query_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS query, CASE WHEN item_id % 2 = 0 THEN 'docs' ELSE 'lsp' END AS domain,
  CAST(least(30, greatest(1, CASE WHEN item_id = 0 THEN 10 ELSE item_id END)) AS INT) AS top_k, 'normal' AS priority, 'sig' || item_id AS signals
FROM benchmark""")
def src_golden(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark, "golden")
    i = F.col("item_id")
    line = F.to_json(
        F.struct(
            i.cast("string").alias("id"), F.col("text").alias("query"),
            F.when(i % 2 == 1, "LSP").alias("domain"), i.cast("int").alias("top_k"),
            F.array(F.concat(F.lit(" sig"), i), F.lit(" ")).alias("expected_signals"),
        )
    )
    table(spark, sf, "benchmark").select(F.concat(F.lit("# comment\n\n"), line).alias("value")).write.text(path)
    out = files.read_golden(spark, path)
    return out.select(
        "query_id", "query", "domain", "top_k", "priority", F.array_join("expected_signals_all", ",").alias("signals")
    )


_COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
            "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("src_table", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def src_table(spark: SparkSession, sf: str) -> DataFrame:
    counts = [
        table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in _COUNTED
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("snk_chunks", f"""
WITH k AS (SELECT sha1({CLEAN}) AS content_hash, doc_id, lang, source FROM documents WHERE length({CLEAN}) >= 50),
r AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id DESC) = 1)
SELECT 'docs' AS domain, content_hash, sha1('doc/' || source || '/' || doc_id || '::' || content_hash) AS chunk_id, lang AS context FROM r""")
def snk_chunks(spark: SparkSession, sf: str) -> DataFrame:
    root = _fresh(spark, "chunks")
    status = ingest.doc_status(doc_lines(documents(spark, sf)))
    batch = merge.keep_last(ingest.doc_chunks(status), "input_pos")
    buckets.merge_into(batch, root, F.current_timestamp())
    return buckets.read(spark, root).select("domain", "content_hash", "chunk_id", "context")


@query("snk_json_report", f"""{HITS}
SELECT 'docs' AS domain, {_METRICS} FROM hits UNION ALL SELECT 'overall', {_METRICS} FROM hits UNION ALL SELECT 'lsp', 0, 0, 0, 0, 0""")
def snk_json_report(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark, "report")
    hits = _hits(spark, sf)
    sinks.write_eval_report(_round(ev.metrics_by_domain(hits)), hits, path)
    schema = "domain string, queries bigint, evaluated bigint, recall_at_3 double, recall_at_5 double, mrr_at_10 double"
    return spark.read.schema(schema).json(f"{path}/metrics")


@query("snk_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def snk_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark, "csv")
    sinks.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return spark.read.option("header", True).option("sep", ";").csv(path)


@query("snk_jsonl", "SELECT doc_id, lang, sha1(text) AS text_sha1 FROM documents")
def snk_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark, "lines")
    sinks.write_jsonl(documents(spark, sf).select("doc_id", "lang", "text"), path)
    return spark.read.schema("doc_id bigint, lang string, text string").json(path).select(
        "doc_id", "lang", F.sha1("text").alias("text_sha1")
    )
