"""Report model queries: every document is read as a model, its lines as bands, its words as fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.operators import bands, layout
from corpusops.operators import models as mdl
from corpusops.operators import requests as req
from corpusops.plans.registry import query
from corpusops.tables import documents, table


def model_columns(doc: Callable[[str], Column]) -> list[Column]:
    """The columns of a document's model; ``doc`` gives a document's column by name.

    Line i is a band with tag 100 * (i mod 7), word j a child; every third word is bound to
    a table named by its length.
    """
    def child(w, j):
        bound = j % 3 == 0
        return F.struct(
            F.when(bound, "TSCadastro").otherwise("TLabel").alias("type"),
            w.alias("name"),
            F.when(~bound, w).alias("caption"),
            F.when(bound, F.concat(F.lit("r0"), F.lpad(F.length(w).cast("string"), 2, "0"), F.lit("tab"))).alias("table"),
            F.lit(None).cast("string").alias("field"),
            F.lit(None).cast("string").alias("tableField"),
        )

    def band(line, i):
        tag = (i % 7) * 100
        return F.struct(
            F.concat(F.lit("Band"), i).alias("name"),
            bands.band_type(tag).alias("bandType"),
            tag.alias("tag"),
            F.array(F.concat(F.lit("E"), F.lpad((i % 4).cast("string"), 3, "0"), F.lit("lst"))).alias("tableList"),
            F.transform(F.filter(F.split(line, " "), lambda w: w != ""), child).alias("children"),
        )

    source = F.regexp_replace(doc("text"), "th", "R123")
    return [
        F.concat(F.lit("01-"), doc("source"), F.lit("_"), doc("lang"), doc("doc_id"), F.lit(".json")).alias("filename"),
        doc("source").alias("caption"), F.lit("1").alias("version"), doc("lang").alias("orientation"),
        F.lit(None).cast("string").alias("reportType"), F.lit(None).cast("string").alias("formatReport"),
        F.create_map(F.lit("selection"), source).alias("sections"),
        F.transform(F.split(doc("text"), "\n", -1), band).alias("bands"),
    ]


def as_models(docs: DataFrame) -> DataFrame:
    return docs.select(*model_columns(F.col))


_FILE = "'01-' || source || '_' || lang || doc_id || '.json'"
_LINES = f"""ln AS (SELECT {_FILE} AS filename, lang, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS band_no FROM documents)"""
_WORDS = """wd AS (SELECT filename, lang, band_no, unnest(list_filter(string_split(line, ' '), lambda w: w <> '')) AS name,
  generate_subscripts(list_filter(string_split(line, ' '), lambda w: w <> ''), 1) - 1 AS child_no FROM ln)"""
_TAGS = " ".join(f"WHEN tag BETWEEN {a} AND {b} THEN '{k}'" for a, b, k in bands.TAG_TYPES)
_BAND_TYPE = f"CASE {_TAGS} ELSE 'TAG_' || tag END"


@query("mdl_flatten", f"""WITH {_LINES}, {_WORDS}
SELECT ln.filename, CAST(ln.band_no AS INT) AS band_no, CAST(wd.child_no AS INT) AS child_no, wd.name,
  CASE WHEN child_no % 3 = 0 THEN 'TSCadastro' WHEN child_no IS NOT NULL THEN 'TLabel' END AS type
FROM ln LEFT JOIN wd ON wd.filename = ln.filename AND wd.band_no = ln.band_no""")
def mdl_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return mdl.flatten(as_models(documents(spark, sf))).select("filename", "band_no", "child_no", "name", "type")


@query("mdl_refs", f"""WITH {_LINES}, {_WORDS},
t AS (SELECT filename, upper('r0' || lpad(CAST(length(name) AS VARCHAR), 2, '0') || 'tab') AS tab FROM wd WHERE child_no % 3 = 0
  UNION SELECT filename, 'E' || lpad(CAST(band_no % 4 AS VARCHAR), 3, '0') || 'LST' FROM ln
  UNION SELECT {_FILE}, upper(unnest(regexp_extract_all(replace(text, 'th', 'R123'), '\\b[REre]\\d{{3}}\\w+'))) FROM documents),
f AS (SELECT {_FILE} AS filename, len(regexp_extract_all(replace(text, 'th', 'R123'), '(?is)(?:SELECT|INSERT|UPDATE|DELETE|FROM|JOIN|WHERE).*?;')) AS n FROM documents)
SELECT t.filename, string_agg(tab, ',' ORDER BY tab) AS tables_referenced, CAST(any_value(f.n) AS BIGINT) AS n_fragments
FROM t JOIN f USING (filename) GROUP BY t.filename""")
def mdl_refs(spark: SparkSession, sf: str) -> DataFrame:
    out = mdl.references(as_models(documents(spark, sf)))
    return out.select(
        "filename", F.array_join("tables_referenced", ",").alias("tables_referenced"),
        F.size("sql_fragments").cast("long").alias("n_fragments"),
    )


def model_files(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        F.concat(F.lit("01-"), "source", F.lit("_"), "lang", "doc_id", F.lit(".json")).alias("name"),
        F.col("text").alias("content"),
    )


@query("mdl_search", f"""
SELECT {_FILE} AS filename, '01' AS number, source AS category, lang || doc_id AS model_code FROM documents
WHERE contains('01-' || source || '_' || lang || doc_id || '.json', 'src1') AND (contains({_FILE}, 'tion') OR contains(lower(text), 'tion'))""")
def mdl_search(spark: SparkSession, sf: str) -> DataFrame:
    return mdl.search(model_files(spark, sf), "Tion", "SRC1")


@query("mdl_get", f"SELECT {_FILE} AS name, sha1(text) AS content_sha1 FROM documents ORDER BY doc_id LIMIT 1")
def mdl_get(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "documents").orderBy("doc_id").select("source", "lang", "doc_id").first()
    found = mdl.get_model(model_files(spark, sf), f"01-{first['source']}_{first['lang']}{first['doc_id']}.json")
    return found.select("name", F.sha1("content").alias("content_sha1"))


@query("mdl_keyword_topk", f"""
WITH w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM benchmark),
c AS (SELECT item_id, word, count(*) AS n FROM w GROUP BY item_id, word),
v AS (SELECT DISTINCT word FROM c),
h AS (SELECT {_FILE} AS name, word FROM documents, v WHERE contains(lower({_FILE}) || chr(1) || lower(text), word)),
s AS (SELECT item_id, name, sum(n) AS score FROM c JOIN h USING (word) GROUP BY item_id, name),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, name) AS rank FROM s QUALIFY rank <= 5)
SELECT CAST(item_id AS VARCHAR) AS request_id, CAST(rank AS INT) AS rank, name, CAST(score AS BIGINT) AS score,
  sha1(CASE WHEN length(text) > 3000 THEN substring(text, 1, 3000) || '...(truncated)' ELSE text END) AS shown_sha1
FROM r JOIN documents ON name = {_FILE}""")
def mdl_keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    return mdl.keyword_topk(model_files(spark, sf), asked).select(
        "request_id", "rank", "name", "score", F.sha1("shown").alias("shown_sha1")
    )


@query("mdl_pick_examples", f"""
WITH f AS (SELECT {_FILE} AS name FROM documents),
p AS (SELECT 0 AS pos, min(name) AS name, 'src3' AS category FROM f WHERE contains(name, 'src3')
  UNION ALL SELECT 1, min(name), 'src12' FROM f WHERE contains(name, 'src12')),
d AS (SELECT 10 AS pos, min(name) AS name, 'default' AS category FROM f WHERE name NOT IN (SELECT name FROM p)),
a AS (SELECT * FROM p UNION ALL SELECT * FROM d)
SELECT name, category, CAST(row_number() OVER (ORDER BY pos, name) AS INT) AS n FROM a""")
def mdl_pick_examples(spark: SparkSession, sf: str) -> DataFrame:
    files = model_files(spark, sf).select("name")
    low = files.agg(F.min("name")).first()[0]
    return mdl.pick_examples(files, ["src3", "src12", "nothing"], [low], 5)


@query("mdl_validate", f"""WITH {_LINES}, {_WORDS},
b AS (SELECT filename, {_BAND_TYPE} AS bt FROM (SELECT *, (band_no % 7) * 100 AS tag FROM ln)),
g AS (SELECT filename, bool_or(bt = 'CABECALHO') AS hd, bool_or(bt = 'DETALHE') AS dt FROM b GROUP BY filename)
SELECT filename, 'warning' AS severity, 'No CABECALHO band (page header)' AS message FROM g WHERE NOT hd
UNION ALL SELECT filename, 'error', 'No DETALHE band (data rows)' FROM g WHERE NOT dt
UNION ALL SELECT filename, 'warning', 'TSCadastro ' || name || ': table "r0' || lpad(CAST(length(name) AS VARCHAR), 2, '0') || 'tab" not found'
FROM wd WHERE child_no % 3 = 0 AND length(name) NOT BETWEEN 2 AND 9""")
def mdl_validate(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([(f"R00{i}TAB",) for i in range(2, 10)], "table string")
    return mdl.validate(as_models(documents(spark, sf)), known)


@query("mdl_diff", f"""WITH {_LINES}, {_WORDS},
ln2 AS (SELECT {_FILE} AS filename, lang, unnest(string_split(t2, chr(10))) AS line, generate_subscripts(string_split(t2, chr(10)), 1) - 1 AS band_no
  FROM (SELECT *, replace(text, 'tion', 'cion') || CASE WHEN lang = 'fr' THEN chr(10) || 'fin' ELSE '' END AS t2 FROM documents)),
wd2 AS (SELECT filename, band_no, unnest(list_filter(string_split(line, ' '), lambda w: w <> '')) AS name,
  generate_subscripts(list_filter(string_split(line, ' '), lambda w: w <> ''), 1) - 1 AS child_no FROM ln2),
ch AS (SELECT a.filename, a.band_no, a.child_no, a.name AS x, b.name AS y FROM wd a JOIN wd2 b
  ON a.filename = b.filename AND a.band_no = b.band_no AND a.child_no = b.child_no WHERE a.name <> b.name),
sec AS (SELECT {_FILE} AS filename, trim(replace(text, 'th', 'R123'), ' ') AS x,
  trim(replace(replace(text, 'tion', 'cion') || CASE WHEN lang = 'fr' THEN chr(10) || 'fin' ELSE '' END, 'th', 'R123'), ' ') AS y FROM documents)
SELECT filename, 'bands[' || band_no || '].children[' || child_no || '].name' AS path, x AS before, y AS after FROM ch
UNION ALL SELECT filename, 'bands[' || band_no || '].children[' || child_no || '].caption', x, y FROM ch WHERE child_no % 3 <> 0
UNION ALL SELECT filename, 'sections.selection.length', CAST(length(x) AS VARCHAR), CAST(length(y) AS VARCHAR) FROM sec WHERE x <> y
UNION ALL SELECT filename, 'bands.length', CAST(count(*) AS VARCHAR), CAST(count(*) + 1 AS VARCHAR) FROM ln WHERE lang = 'fr' GROUP BY filename""")
def mdl_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Against a copy with one letter sequence replaced and, in French, one more line."""
    docs = documents(spark, sf)
    extra = F.when(F.col("lang") == "fr", F.lit("\nfin")).otherwise("")
    newer = docs.withColumn("text", F.concat(F.replace("text", F.lit("tion"), F.lit("cion")), extra))
    return mdl.diff(as_models(docs), as_models(newer))


@query("mdl_errors", """
SELECT substring(event_type || ' failed for user ' || user_id || ' with a long explanation that is cut off', 1, 60) AS message, count(*) AS total
FROM events GROUP BY 1 ORDER BY total DESC, message LIMIT 20""")
def mdl_errors(spark: SparkSession, sf: str) -> DataFrame:
    message = F.concat(
        "event_type", F.lit(" failed for user "), "user_id", F.lit(" with a long explanation that is cut off")
    )
    return mdl.error_stats(table(spark, sf, "events").withColumn("message", message), "message")


FLAGS = {"breaks": r"group|the\s+th", "totals": "tion|sum", "rules": "where|que", "multi_detail": "sch.*lich", "landscape": r"und\s+"}
WORDS = {"tion": "R001", "est": "R002", "the": "R003", "ment": "R002", "que": "R004", "heit": "R005"}


def _flag_sql(name: str) -> str:
    return f"regexp_matches(text, '(?is){FLAGS[name]}')"


@query("req_tag", f"""
WITH f AS (SELECT doc_id, {', '.join(f'{_flag_sql(n)} AS {n}' for n in FLAGS)} FROM documents)
SELECT doc_id, breaks, totals, rules, multi_detail, landscape,
  CASE WHEN multi_detail THEN 'multi-detail' ELSE (CASE WHEN breaks AND totals THEN 'break-report,total-report' WHEN breaks THEN 'break-report'
    WHEN totals THEN 'total-report' ELSE 'simple-list' END) || CASE WHEN rules THEN ',complex-rules' ELSE '' END END AS categories FROM f""")
def req_tag(spark: SparkSession, sf: str) -> DataFrame:
    flags = req.flags(F.col("text"), FLAGS)
    tagged = documents(spark, sf).select("doc_id", *[c.alias(n) for n, c in flags.items()])
    cats = req.categories(F.col("breaks"), F.col("totals"), F.col("rules"), F.col("multi_detail"))
    return tagged.withColumn("categories", F.array_join(cats, ","))


@query("req_tables", f"""
SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(text), '{w}') THEN '{t}' END" for w, t in WORDS.items())}], lambda x: x IS NOT NULL), ',') AS tables
FROM documents""")
def req_tables(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(req.table_hits(F.col("text"), WORDS), ",").alias("tables"))


def _sample(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a sheet of strings with a date, a currency and two thin columns."""
    return table(spark, sf, "events").select(
        F.date_format("ts", "dd/MM/yyyy").alias("day"),
        F.concat(F.lit("R$ "), F.col("value").cast("string")).alias("amount"),
        "event_type",
        F.when(F.col("user_id") % 10 < 4, F.col("user_id").cast("string")).otherwise("").alias("sparse"),
        F.when(F.col("user_id") % 10 < 5, F.concat(F.lit("x"), "user_id")).otherwise(F.col("user_id").cast("string")).alias("mixed"),
        F.lit("").alias("blank"),
    )


_SHEET = """s AS (SELECT strftime(ts, '%d/%m/%Y') AS day, 'R$ ' || CAST(value AS VARCHAR) AS amount, event_type,
  CASE WHEN user_id % 10 < 4 THEN CAST(user_id AS VARCHAR) ELSE '' END AS sparse,
  CASE WHEN user_id % 10 < 5 THEN 'x' || user_id ELSE CAST(user_id AS VARCHAR) END AS mixed, '' AS blank FROM events),
l AS (SELECT unnest([{'pos': 1, 'header': 'day', 'v': day}, {'pos': 2, 'header': 'amount', 'v': amount}, {'pos': 3, 'header': 'event_type', 'v': event_type},
  {'pos': 4, 'header': 'sparse', 'v': sparse}, {'pos': 5, 'header': 'mixed', 'v': mixed}, {'pos': 6, 'header': 'blank', 'v': blank}], recursive := true) FROM s),
p AS (SELECT pos, header, count(*) FILTER (WHERE v <> '') AS n, count(*) FILTER (WHERE regexp_matches(v, '\\d{2}[/\\-]\\d{2}[/\\-]\\d{2,4}')) AS dates,
  count(*) FILTER (WHERE regexp_matches(regexp_replace(v, '[R$.,\\s]', '', 'g'), '^[+-]?(\\d|Infinity)')) AS numbers FROM l GROUP BY pos, header),
t AS (SELECT *, CASE WHEN n = 0 THEN 'text' WHEN dates > n * 0.5 THEN 'date' WHEN numbers > n * 0.7 THEN 'number' ELSE 'text' END AS type FROM p)"""


@query("lay_profile", f"""WITH {_SHEET}
SELECT pos, header, type, CASE type WHEN 'number' THEN 'right' WHEN 'date' THEN 'center' ELSE 'left' END AS align, 17 AS width_pct FROM t""")
def lay_profile(spark: SparkSession, sf: str) -> DataFrame:
    return layout.column_profile(_sample(spark, sf))


@query("lay_flags", """
SELECT 'landscape' AS orientation, (SELECT contains(lower(text), 'sum') OR contains(lower(text), 'total') OR contains(lower(text), 'soma') FROM documents ORDER BY doc_id DESC LIMIT 1) AS has_totals,
  (SELECT count(*) >= 2 FROM documents WHERE doc_id < 50 AND lang <> 'en') AS has_grouping, 9 AS total_columns, count(*) AS total_rows FROM documents""")
def lay_flags(spark: SparkSession, sf: str) -> DataFrame:
    only_en = [F.when(F.col("lang") == "en", "x").otherwise("").alias(f"c{i}") for i in range(1, 9)]
    sheet = documents(spark, sf).select(F.col("doc_id").alias("pos"), F.col("text").alias("c0"), *only_en)
    return layout.flags(sheet, "pos", [f"c{i}" for i in range(9)])
