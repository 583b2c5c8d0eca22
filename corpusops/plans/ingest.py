"""Ingest queries: cleaning, keys, cutting, tagging, merging and run statistics."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.functions.text import collapse_whitespace, once, split_lines
from corpusops.operators import chunking, ingest, merge, reindex, tagging
from corpusops.operators.lexical import BROADCAST_ROWS
from corpusops.operators.tagging import TagRule
from corpusops.plans.registry import query
from corpusops.plans.sqltext import clean_sql, trim_sql
from corpusops.session import scratch_dir
from corpusops.streaming.incremental import run_available
from corpusops.tables import documents, table

CLEAN = clean_sql("text")


@query("ing_collapse_ws", f"""
SELECT doc_id, sha1({CLEAN}) AS text_sha1, CAST(length({CLEAN}) AS BIGINT) AS n FROM documents""")
def ing_collapse_ws(spark: SparkSession, sf: str) -> DataFrame:
    t = collapse_whitespace(F.col("text"))
    return documents(spark, sf).select("doc_id", t.alias("t")).select(
        "doc_id", F.sha1("t").alias("text_sha1"), F.length("t").cast("long").alias("n")
    )


@query("ing_min_chars", f"""
SELECT doc_id, CAST(length({CLEAN}) AS BIGINT) AS n FROM documents WHERE length({CLEAN}) >= 50""")
def ing_min_chars(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length(collapse_whitespace(F.col("text"))).cast("long")
    docs = once(documents(spark, sf), n=n).select("doc_id", "n")
    return docs.filter(F.col("n") >= ingest.min_chars())


@query("ing_content_hash", f"""
SELECT doc_id, coalesce(nullif(CASE WHEN source = 'src0' THEN 'given-' || doc_id ELSE '' END, ''),
                        sha1({CLEAN})) AS content_hash
FROM documents""")
def ing_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("source") == "src0", F.concat(F.lit("given-"), F.col("doc_id"))).otherwise("")
    return documents(spark, sf).select(
        "doc_id", ingest.content_hash(given, collapse_whitespace(F.col("text"))).alias("content_hash")
    )


@query("ing_chunk_id", f"""
WITH h AS (SELECT page_id, url, sha1({clean_sql('html')}) AS hash, {clean_sql('html')} AS body FROM pages),
k AS (SELECT *, sha1(url || ':1:' || CAST(page_id AS VARCHAR) || ':' || body) AS source_hash FROM h)
SELECT page_id, sha1(url || '::' || hash) AS chunk_id,
       substring(sha1('lsp::' || url || '::0::' || source_hash), 1, 32) AS source_chunk_id
FROM k""")
def ing_chunk_id(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("body", collapse_whitespace(F.col("html")))
    h = ingest.source_chunk_hash(F.col("url"), F.lit("1"), F.col("page_id").cast("string"), F.col("body"))
    return pages.select(
        "page_id",
        ingest.doc_chunk_id(F.lit(None).cast("string"), F.col("url"), F.sha1("body")).alias("chunk_id"),
        ingest.source_chunk_id(F.col("url"), F.lit("0"), h).alias("source_chunk_id"),
    )


def doc_lines(docs: DataFrame) -> DataFrame:
    """``documents`` in the shape of the JSON input lines."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.lit("").alias("chunk_id"),
        F.concat(F.lit("doc/"), "source", F.lit("/"), "doc_id").alias("source_url"),
        none.alias("source_root"),
        F.col("lang").alias("context"),
        F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("product"),
        none.alias("version"),
        F.concat(F.lit("Title "), "doc_id").alias("title"),
        F.lit("").alias("heading_path"),
        "text",
        F.lit("").alias("content_hash"),
        none.alias("last_modified"),
        F.lit("").alias("crawl_strategy"),
        none.alias("_corrupt_record"),
        F.col("doc_id").alias("input_pos"),
    )


@query("ing_metadata", """
SELECT CAST(doc_id AS VARCHAR) AS id, to_json({
  'title': 'Title ' || doc_id, 'source_root': '', 'source_url': 'doc/' || source || '/' || doc_id,
  'context': lang, 'product': CASE WHEN source = 'src1' THEN '' ELSE source END, 'version': '',
  'heading_path': '', 'last_modified': CAST(NULL AS VARCHAR), 'crawl_strategy': CAST(NULL AS VARCHAR)
}) AS metadata FROM documents""")
def ing_metadata(spark: SparkSession, sf: str) -> DataFrame:
    lines = doc_lines(documents(spark, sf))
    return lines.select(
        F.col("input_pos").cast("string").alias("id"),
        F.to_json(ingest.doc_metadata(lines), {"ignoreNullFields": "false"}).alias("metadata"),
    )


# pieces of every document, cut one after the other
PIECES = f"""WITH RECURSIVE t AS (SELECT doc_id, {CLEAN} AS t FROM documents),
src AS (SELECT doc_id, t, length(t) AS n FROM t WHERE length(t) > 0),
cuts AS (
  SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS st, CAST(-1 AS BIGINT) AS en, CAST(0 AS BIGINT) AS nxt, t, n FROM src
  UNION ALL
  SELECT doc_id, k + 1, st, en, CASE WHEN en >= n THEN n ELSE greatest(en - 220, st + 1) END, t, n
  FROM (
    SELECT doc_id, k, st, t, n,
      CASE WHEN hard >= n THEN n
           WHEN (CASE WHEN nl > st + 700 THEN nl ELSE sp END) > st + 560
             THEN (CASE WHEN nl > st + 700 THEN nl ELSE sp END)
           ELSE hard END AS en
    FROM (
      SELECT doc_id, k, nxt AS st, t, n, least(n, nxt + 1400) AS hard,
        nxt + length(regexp_extract(substring(t, nxt + 1, 1401), '^(?s:(.*))\\n', 1)) AS nl,
        nxt + length(regexp_extract(substring(t, nxt + 1, 1401), '^(?s:(.*)) ', 1)) AS sp
      FROM cuts WHERE nxt < n))
),
pieces AS (SELECT doc_id, k, {trim_sql('substring(t, st + 1, en - st)')} AS piece FROM cuts WHERE k > 0)"""


@query("ing_split_overlap", f"""
{PIECES}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS piece_no,
       sha1(piece) AS piece_sha1, CAST(length(piece) AS BIGINT) AS n
FROM pieces WHERE piece <> ''""")
def ing_split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select(
        "doc_id", F.posexplode(chunking.split_overlap(F.col("text"))).alias("i", "piece")
    )
    return docs.select(
        "doc_id", (F.col("i") + 1).cast("long").alias("piece_no"), F.sha1("piece").alias("piece_sha1"),
        F.length("piece").cast("long").alias("n"),
    )


# a line start that occurs in the given texts, in place of the routine words
LINE_START = r"(?i)^\s*(?:the|is|of|to|and|la|le|de|der|die|und|el|et)\s+(\S+)"


@query("ing_routine_chunks", f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents),
m AS (SELECT *, regexp_matches(line, '{LINE_START}') AS is_start FROM l),
b AS (SELECT *, sum(CAST(is_start AS INT)) OVER (PARTITION BY doc_id ORDER BY no) AS block_no FROM m)
SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, CAST(min(no) AS BIGINT) AS start_line,
       CAST(max(no) AS BIGINT) AS end_line,
       regexp_extract(min_by(line, no), '{LINE_START}', 1) AS routine_name,
       sha1(string_agg(line, chr(10) ORDER BY no)) AS block_sha1
FROM b WHERE block_no > 0 GROUP BY doc_id, block_no""")
def ing_routine_chunks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = chunking.routine_blocks(documents(spark, sf), ["doc_id"], LINE_START)
    return blocks.select(
        "doc_id", F.col("block_no").cast("long").alias("block_no"),
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        "routine_name", F.sha1("block").alias("block_sha1"),
    )


@query("ing_signature_prefix", f"""
WITH l AS (
  SELECT conv_id, turn, string_split(text, chr(10))[1] AS first_line,
         unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM conversations),
s AS (SELECT *, coalesce(nullif({clean_sql('first_line')}, ''), 'routine') AS sig FROM l)
SELECT conv_id, turn, CAST(no AS BIGINT) AS line_no,
       sha1(CASE WHEN contains(lower(line), lower(sig)) THEN line ELSE sig || chr(10) || line END) AS piece_sha1
FROM s""")
def ing_signature_prefix(spark: SparkSession, sf: str) -> DataFrame:
    lines = split_lines(F.col("text"))
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", chunking.signature(F.get(lines, F.lit(0)), F.lit("routine")).alias("sig"),
        F.posexplode(lines).alias("i", "line"),
    )
    return rows.select(
        "conv_id", "turn", (F.col("i") + 1).cast("long").alias("line_no"),
        F.sha1(chunking.with_signature(F.col("line"), F.col("sig"))).alias("piece_sha1"),
    )


@query("ing_line_spans", f"""
{PIECES},
num AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS piece_no, len(string_split(piece, chr(10))) AS n FROM pieces WHERE piece <> ''),
tot AS (SELECT doc_id, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS total FROM documents),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS piece_no, CAST(0 AS BIGINT) AS line_start, CAST(0 AS BIGINT) AS line_end, CAST(1 AS BIGINT) AS nxt, total FROM tot
  UNION ALL
  SELECT doc_id, no, st, en, greatest(en - 6, st + 1), total
  FROM (SELECT doc_id, num.piece_no AS no, nxt AS st, least(total, nxt + n - 1) AS en, total
        FROM walk JOIN num USING (doc_id) WHERE num.piece_no = walk.piece_no + 1)
)
SELECT doc_id, CAST(piece_no AS INT) AS piece_no, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end FROM walk WHERE piece_no > 0""")
def ing_line_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select(
        "doc_id", chunking.split_overlap(F.col("text")).alias("pieces"),
        F.size(split_lines(F.col("text"))).alias("n"),
    )
    spans = chunking.line_spans(F.col("pieces"), F.lit(1), F.col("n"))
    return docs.select("doc_id", F.posexplode(spans).alias("piece_no", "s")).select(
        "doc_id", (F.col("piece_no") + 1).alias("piece_no"), "s.line_start", "s.line_end"
    )


@query("ing_fixed_blocks", f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
s AS (SELECT doc_id, lines, unnest(range(0, len(lines), 68)) AS st FROM l),
k AS (SELECT * FROM s WHERE st = 0 OR st - 68 + 80 < len(lines)),
b AS (SELECT doc_id, st + 1 AS line_start, least(st + 80, len(lines)) AS line_end,
             {trim_sql("array_to_string(lines[st + 1 : st + 80], chr(10))")} AS block FROM k)
SELECT doc_id, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end,
       sha1(block) AS block_sha1
FROM b WHERE block <> ''""")
def ing_fixed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", F.explode(chunking.fixed_blocks(F.col("text"))).alias("b"))
    return rows.select(
        "doc_id", F.col("b.line_start").cast("long").alias("line_start"),
        F.col("b.line_end").cast("long").alias("line_end"), F.sha1("b.block").alias("block_sha1"),
    )


DROP_TERMS = ["license", "copyright", "the th", "http"]
_DROP = " AND ".join(f"NOT contains(upper(x), '{t.upper()}')" for t in DROP_TERMS)


@query("ing_drop_lines", f"""
SELECT doc_id, sha1({trim_sql(f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: {_DROP}), chr(10))")}) AS text_sha1
FROM documents""")
def ing_drop_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", F.sha1(chunking.drop_lines(F.col("text"), DROP_TERMS)).alias("text_sha1")
    )


RULES = [
    TagRule(match="blog.", module="blog", context="web"),
    TagRule(match="/en/", product="english", heading_path="English"),
    TagRule(match="/fr/", product="french"),
    TagRule(match="www.", module="site", version="1"),
    TagRule(match="example.org", context="org", routine_name="org-page"),
    TagRule(match="spam", module="junk", heading_path="Junk"),
]
_RULE_ROWS = ", ".join(
    "(" + ", ".join(
        [str(i)] + [f"'{v}'" if v else "NULL" for v in
                    (r.match, r.module, r.routine_name, r.heading_path, r.context, r.product, r.version)]
    ) + ")"
    for i, r in enumerate(RULES)
)
PATH_SQL = "regexp_replace(url, '[?#].*$', '')"
BASE_SQL = "regexp_extract(url, '^[a-z]+://[^/]+', 0)"


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    """``pages`` as source files: the url without its query is the path, its site the base."""
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_replace("url", "[?#].*$", "").alias("path"),
        F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("base"),
    )


_REL = """CASE WHEN starts_with(path, base || '/') THEN substring(path, length(base) + 2)
            ELSE string_split(path, '/')[-1] END"""
PATHS = f"""p AS (SELECT page_id, {PATH_SQL} AS path, {BASE_SQL} AS base FROM pages),
r AS (SELECT *, CASE WHEN string_split(base, '/')[-1] = '' THEN {_REL}
                     ELSE string_split(base, '/')[-1] || '/' || ({_REL}) END AS rel FROM p),
f AS (SELECT *, list_filter(string_split(rel, '/'), lambda s: s <> '') AS parts,
             string_split(regexp_replace(rel, '/+$', ''), '/')[-1] AS file FROM r),
g AS (SELECT *, CASE WHEN len(parts) <= 1 THEN 'root' ELSE parts[1] END AS module,
             coalesce(nullif(CASE WHEN instr(substring(file, 2), '.') > 0 THEN regexp_replace(file, '\\.[^.]*$', '') ELSE file END, ''), 'routine') AS routine_name FROM f)"""


@query("ing_path_fields", f"""
WITH {PATHS}
SELECT page_id, rel AS relative_path, module, routine_name, rel || '::' || path AS source_key FROM g""")
def ing_path_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = page_paths(spark, sf)
    rel = tagging.relative_path(F.col("path"), F.col("base"), F.lit("/"))
    return p.withColumn("relative_path", rel).select(
        "page_id", "relative_path",
        tagging.module_name(F.col("relative_path")).alias("module"),
        tagging.routine_from_file(F.col("relative_path")).alias("routine_name"),
        tagging.source_key(F.col("relative_path"), F.col("path")).alias("source_key"),
    )


def _last_rule(field: str, default: str) -> str:
    return f"coalesce(max_by({field}_, pos) FILTER (WHERE {field}_ IS NOT NULL), {default}) AS {field}"


@query("ing_tag_rules", f"""
WITH {PATHS},
rules(pos, match, module_, routine_name_, heading_path_, context_, product_, version_) AS (VALUES {_RULE_ROWS}),
j AS (SELECT g.page_id, g.module AS m, g.routine_name AS rn, rules.*
      FROM g LEFT JOIN rules ON contains(upper(path), upper(match)) OR contains(upper(rel), upper(match)))
SELECT page_id, {_last_rule('module', 'any_value(m)')}, {_last_rule('routine_name', 'any_value(rn)')},
       {_last_rule('heading_path', 'any_value(rn)')}, {_last_rule('context', 'NULL')},
       {_last_rule('product', 'NULL')}, {_last_rule('version', 'NULL')}
FROM j GROUP BY page_id""")
def ing_tag_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = page_paths(spark, sf).withColumn(
        "rel", tagging.relative_path(F.col("path"), F.col("base"), F.lit("/"))
    )
    tags = tagging.apply_rules(
        F.col("path"), F.col("rel"), RULES,
        tagging.module_name(F.col("rel")), tagging.routine_from_file(F.col("rel")),
    )
    return p.select("page_id", *[c.alias(n) for n, c in tags.items()])


@query("src_ext_filter", f"""
SELECT page_id, url FROM pages
WHERE lower(regexp_extract({PATH_SQL}, '[^/](\\.[^./]*)$', 1)) IN ('.html', '.xml', '.txt')""")
def src_ext_filter(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf, "pages").filter(
        tagging.allowed_extension(path, [".html", ".xml", ".txt"])
    ).select("page_id", "url")


@query("src_path_ignore", """
SELECT page_id, url FROM pages
WHERE NOT contains(upper(url), 'SPAM') AND NOT contains(upper(url), '/DE/') AND NOT contains(upper(url), 'UTM_')""")
def src_path_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").filter(
        ~tagging.path_ignored(F.col("url"), F.lit(""), ["spam", "/de/", "utm_"])
    ).select("page_id", "url")


@query("ing_embed_input", f"""
SELECT doc_id, sha1(
  'domain: docs' || chr(10) || 'context: ' || lang || chr(10) ||
  CASE WHEN source = 'src1' THEN '' ELSE 'product: ' || source || chr(10) END ||
  'title: Title ' || doc_id || chr(10) || 'source_url: doc/' || source || '/' || doc_id || chr(10) ||
  'content:' || chr(10) || {CLEAN}) AS input_sha1
FROM documents WHERE length({CLEAN}) >= 50""")
def ing_embed_input(spark: SparkSession, sf: str) -> DataFrame:
    status = ingest.doc_status(doc_lines(documents(spark, sf)))
    chunks = ingest.doc_chunks(status)
    title = F.get_json_object("metadata", "$.title")
    return chunks.select(
        F.col("input_pos").alias("doc_id"), F.sha1(ingest.doc_embedding_input(title)).alias("input_sha1")
    )


@query("ing_dedupe_last", f"""
WITH k AS (SELECT sha1({CLEAN}) AS content_hash, doc_id, lang, source FROM documents WHERE length({CLEAN}) >= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id DESC) AS rn FROM k)
SELECT 'docs' AS domain, content_hash, doc_id, lang AS context, source FROM r WHERE rn = 1""")
def ing_dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(documents(spark, sf), t=collapse_whitespace(F.col("text"))).filter(F.length("t") >= 50).select(
        F.lit("docs").alias("domain"), F.sha1("t").alias("content_hash"), "doc_id",
        F.col("lang").alias("context"), "source",
    )
    return merge.keep_last(rows, "doc_id")


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        F.lit("docs").alias("domain"), F.sha1("text").alias("content_hash"), "doc_id", "lang", "source"
    )


NOW = "2024-02-01 00:00:00"
THEN = "2024-01-01 00:00:00"


@query("ing_upsert", f"""
WITH k AS (SELECT sha1(text) AS content_hash, doc_id, lang, source FROM documents),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id DESC) AS rn
      FROM k WHERE lang <> 'en') WHERE rn = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id DESC) AS rn
      FROM k WHERE source < 'src15' OR lang = 'en') WHERE rn = 1)
SELECT 'docs' AS domain, coalesce(n.content_hash, o.content_hash) AS content_hash,
       coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.lang, o.lang) AS lang,
       coalesce(n.source, o.source) AS source,
       CASE WHEN o.content_hash IS NULL THEN '{NOW}' ELSE '{THEN}' END AS created_at,
       CASE WHEN n.content_hash IS NULL THEN '{THEN}' ELSE '{NOW}' END AS updated_at
FROM o FULL OUTER JOIN n ON o.content_hash = n.content_hash""")
def ing_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents not in English are the table; the English ones and the sources before src15 are the batch."""
    rows = _hashed(spark, sf)
    then = F.lit(THEN)
    old = merge.keep_last(rows.filter(F.col("lang") != "en"), "doc_id").withColumns(
        {"created_at": then, "updated_at": then}
    )
    batch = merge.keep_last(rows.filter((F.col("source") < "src15") | (F.col("lang") == "en")), "doc_id")
    return merge.upsert(old, batch, F.lit(NOW))


@query("ing_stale_delete", """
SELECT domain, content_hash, doc_id, lang, source FROM (
  SELECT CASE WHEN lang = 'de' THEN 'lsp' ELSE 'docs' END AS domain, sha1(text) AS content_hash, doc_id, lang, source
  FROM documents) t
WHERE domain <> 'docs' OR content_hash IN (SELECT sha1(text) FROM documents WHERE source < 'src2')""")
def ing_stale_delete(spark: SparkSession, sf: str) -> DataFrame:
    rows = _hashed(spark, sf).withColumn("domain", F.when(F.col("lang") == "de", "lsp").otherwise("docs"))
    seen = _hashed(spark, sf).filter(F.col("source") < "src2")
    return merge.drop_stale(rows, seen, "docs")


_STATUS = f"""SELECT CASE WHEN l.toxic = 1 THEN 'error' WHEN length({clean_sql('d.text')}) < 400 THEN 'skipped'
                        ELSE 'ready' END AS status
      FROM documents d LEFT JOIN labels l USING (doc_id)"""


def _doc_status(spark: SparkSession, sf: str) -> DataFrame:
    """Documents labelled toxic stand for lines that do not parse."""
    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    bad = F.when(F.col("toxic") == 1, F.lit("{"))
    return ingest.doc_status(docs.select("text", bad.alias("_corrupt_record")), 400)


@query("ing_stats", f"""
SELECT 'docs' AS domain, count(*) AS scanned, count(*) FILTER (WHERE status = 'ready') AS indexed,
       count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors
FROM ({_STATUS})""")
def ing_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.run_stats(_doc_status(spark, sf), "docs")


@query("ing_reindex_all", f"""
SELECT 'docs' AS domain, count(*) AS scanned, count(*) FILTER (WHERE status = 'ready') AS indexed,
       count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors
FROM ({_STATUS})
UNION ALL
SELECT 'lsp', count(*), count(*) FILTER (WHERE length({clean_sql('html')}) >= 400),
       count(*) FILTER (WHERE length({clean_sql('html')}) < 400), 0
FROM pages""")
def ing_reindex_all(spark: SparkSession, sf: str) -> DataFrame:
    """Both index runs into a fresh chunk table; pages, named by url and page_id, stand for source files. A run that fails has no row but a warning."""
    root = f"{scratch_dir(spark)}/reindex-{uuid.uuid4().hex}"

    def docs() -> dict:
        toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("input_pos"), F.lit("{").alias("bad"))
        toxic = F.broadcast(toxic) if toxic.count() <= BROADCAST_ROWS else toxic
        lines = doc_lines(documents(spark, sf)).join(toxic, "input_pos", "left").withColumn("_corrupt_record", F.col("bad"))
        return reindex.index_documents(lines.drop("bad"), root, full=True, now=NOW, limit=400)

    def lsp() -> dict:
        site = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
        files = table(spark, sf, "pages").select(
            F.concat("url", F.lit("#"), "page_id").alias("path"), site.alias("base"), F.col("html").alias("text"), F.lit("ready").alias("status")
        )
        return reindex.index_sources(files, root, rules=RULES, full=True, now=NOW, limit=400)

    outcome = reindex.reindex_all({"docs": docs, "lsp": lsp})
    for e in outcome.errors:
        warnings.warn(f"index run of {e['domain']} failed: {e['error']}", stacklevel=2)
    if not outcome.runs:
        raise RuntimeError("; ".join(f"{e['domain']}: {e['error']}" for e in outcome.errors))
    counts = ", ".join(f"{c} bigint" for c in reindex.STATS[1:])
    return spark.createDataFrame([tuple(r[c] for c in reindex.STATS) for r in outcome.runs], f"domain string, {counts}")


@query("ing_incremental", f"""
WITH k AS (SELECT sha1({CLEAN}) AS content_hash, doc_id, lang, source FROM documents WHERE length({CLEAN}) >= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id DESC) AS rn FROM k)
SELECT content_hash, doc_id AS input_pos, lang AS context,
       'doc/' || source || '/' || doc_id AS source_url FROM r WHERE rn = 1""")
def ing_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The documents folder as a file stream, merged batch by batch into a fresh table."""
    root = f"{scratch_dir(spark)}/incremental-{uuid.uuid4().hex}"
    schema = table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet")
    out = run_available(spark, doc_lines(stream), f"{root}/table", f"{root}/progress", NOW)
    return out.select("content_hash", "input_pos", "context", "source_url")
