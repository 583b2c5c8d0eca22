"""Queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.functions import scalar as fn
from corpusops.plans.registry import query
from corpusops.tables import documents, table


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


@query("fn_today", "SELECT o_orderkey, CAST(today() - CAST(o_orderdate AS DATE) AS BIGINT) AS age_days FROM orders")
def fn_today(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("o_orderkey", fn.days_between(fn.today(), F.col("d")).cast("long").alias("age_days"))


@query("fn_date_parts", "SELECT o_orderkey, CAST(day(o_orderdate) AS INT) AS day, CAST(month(o_orderdate) AS INT) AS month, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def fn_date_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("o_orderkey", fn.date_parts(F.col("d")).alias("p")).select("o_orderkey", "p.*")


@query("fn_make_date", """
SELECT o_orderkey, strftime(try_cast(printf('%04d-%02d-%02d', CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT), CAST(28 + o_custkey % 4 AS INT)) AS DATE), '%Y-%m-%d') AS made FROM orders""")
def fn_make_date(spark: SparkSession, sf: str) -> DataFrame:
    day = 28 + F.col("o_custkey") % 4
    made = fn.make_date(day, F.month("d"), F.year("d"))
    return _orders(spark, sf).select("o_orderkey", made.cast("string").alias("made"))


@query("fn_days_in_month", "SELECT o_orderkey, CAST(day(last_day(o_orderdate)) AS INT) AS days FROM orders")
def fn_days_in_month(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("o_orderkey", fn.days_in_month(F.month("d"), F.year("d")).alias("days"))


@query("fn_month", "SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month FROM orders")
def fn_month(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("o_orderkey", F.month("d").alias("month"))


@query("fn_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def fn_year(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("o_orderkey", F.year("d").alias("year"))


_MONTHS = ", ".join(f"'{m}'" for m in fn.MONTHS)


@query("fn_date_words", f"""
SELECT o_orderkey, day(o_orderdate) || ' de ' || [{_MONTHS}][month(o_orderdate)] || ' de ' || year(o_orderdate) AS words FROM orders""")
def fn_date_words(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("o_orderkey", fn.date_words(F.col("d")).alias("words"))


@query("fn_date_add", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INT) - 200, '%Y-%m-%d') AS moved FROM orders")
def fn_date_add(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("o_custkey") % 400 - 200).cast("int")
    return _orders(spark, sf).select("o_orderkey", fn.add_days(F.col("d"), n).cast("string").alias("moved"))


@query("fn_date_diff", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1998-01-01' AS BIGINT) AS days FROM orders")
def fn_date_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("o_orderkey", fn.days_between(F.col("d"), F.lit("1998-01-01").cast("date")).cast("long").alias("days"))


@query("fn_null_date", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderstatus = 'P') AS empty, count(*) AS n FROM orders GROUP BY o_orderstatus")
def fn_null_date(spark: SparkSession, sf: str) -> DataFrame:
    d = F.when(F.col("o_orderstatus") != "P", F.col("d"))
    return _orders(spark, sf).groupBy("o_orderstatus").agg(
        F.count_if(fn.null_date(d)).alias("empty"), F.count(F.lit(1)).alias("n")
    )


@query("fn_int_to_str", "SELECT p_partkey, CAST(p_size AS VARCHAR) || '/' || CAST(-p_partkey AS VARCHAR) AS text FROM part")
def fn_int_to_str(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select(
        "p_partkey", F.concat_ws("/", fn.int_to_text(F.col("p_size")), fn.int_to_text(-F.col("p_partkey"))).alias("text")
    )


@query("fn_str_to_int", "SELECT p_partkey, TRY_CAST(trim(substring(p_brand, 6 + p_size % 3, 3)) AS BIGINT) AS n FROM part")
def fn_str_to_int(spark: SparkSession, sf: str) -> DataFrame:
    text = F.substr(F.col("p_brand"), 6 + F.col("p_size") % 3, F.lit(3))
    return _parts(spark, sf).select("p_partkey", fn.text_to_int(text).alias("n"))


@query("fn_replace", "SELECT p_partkey, replace(p_name, 'r', '<r>') AS text FROM part")
def fn_replace(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", fn.replace(F.col("p_name"), F.lit("r"), F.lit("<r>")).alias("text"))


@query("fn_length", "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n FROM part")
def fn_length(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", fn.text_length(F.col("p_name")).cast("long").alias("n"))


@query("fn_char_at", "SELECT p_partkey, substring(p_name, 1 + p_size % 12, 1) AS c FROM part")
def fn_char_at(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", fn.char_at(F.col("p_name"), 1 + F.col("p_size") % 12).alias("c"))


@query("fn_substr", "SELECT p_partkey, substring(p_name, 2 + p_size % 3, 4) AS text FROM part")
def fn_substr(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", fn.copy_text(F.col("p_name"), F.lit(4), 2 + F.col("p_size") % 3).alias("text"))


@query("fn_recode", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents")
def fn_recode(spark: SparkSession, sf: str) -> DataFrame:
    """UTF-8 bytes read as Latin-1 give one character per byte."""
    return documents(spark, sf).select(
        "doc_id", F.length(fn.recode(F.col("text"), "UTF-8", "ISO-8859-1")).cast("long").alias("n")
    )


@query("fn_chr", "SELECT p_partkey, chr(CAST(48 + p_size AS INT)) AS c FROM part")
def fn_chr(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", fn.char_of(48 + F.col("p_size")).alias("c"))


@query("fn_format", "SELECT p_partkey, printf('%05d|%s|%d', p_partkey, p_type, p_size) AS text FROM part")
def fn_format(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select(
        "p_partkey", fn.formatted("%05d|%s|%d", F.col("p_partkey"), F.col("p_type"), F.col("p_size")).alias("text")
    )


@query("fn_mask", "SELECT p_partkey, lpad(printf('%,.2f', p_retailprice), 12, ' ') AS text FROM part")
def fn_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", fn.masked_number(F.col("p_retailprice"), 12, 2).alias("text"))


@query("fn_concat", "SELECT p_partkey, p_name || '-' || CASE WHEN p_size > 25 THEN p_brand ELSE '' END || p_size AS text FROM part")
def fn_concat(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.when(F.col("p_size") > 25, F.col("p_brand"))
    return _parts(spark, sf).select("p_partkey", fn.concat(F.col("p_name"), F.lit("-"), brand, F.col("p_size")).alias("text"))


@query("fn_is_null", "SELECT doc_id, CASE WHEN lang IN ('de', 'fr') THEN 1 ELSE 0 END AS empty FROM documents")
def fn_is_null(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("lang") == "de", "").when(F.col("lang") != "fr", F.col("text"))
    return table(spark, sf, "documents").select("doc_id", fn.is_empty(value).alias("empty"))


@query("fn_round", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)), 2) AS DOUBLE) AS rounded FROM lineitem""")
def fn_round(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("l_extendedprice").cast("decimal(18,2)") * F.lit("0.001").cast("decimal(4,3)")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", fn.rounded(v, 2).alias("rounded")
    )


@query("fn_list_count", "SELECT page_id, CAST(len(string_split(url, '/')) AS INT) AS n FROM pages")
def fn_list_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", fn.list_count(F.col("url"), "/").alias("n"))


@query("fn_list_item", "SELECT page_id, split_part(url, '/', 3) AS site, split_part(url, '/', 9) AS none FROM pages")
def fn_list_item(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", fn.list_item(F.col("url"), "/", 3).alias("site"), fn.list_item(F.col("url"), "/", 9).alias("none")
    )


@query("fn_list_desc", "SELECT c_custkey, n_name AS description FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 3")
def fn_list_desc(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") + 3).alias("code"))
    out = fn.list_description(codes, "code", table(spark, sf, "nation"), "n_nationkey", "n_name")
    return out.select("c_custkey", "description")


@query("fn_count_where", "SELECT count(*) FILTER (WHERE l_quantity > 30 AND l_returnflag = 'R') AS n FROM lineitem")
def fn_count_where(spark: SparkSession, sf: str) -> DataFrame:
    return fn.count_where(table(spark, sf, "lineitem"), (F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R"))


@query("fn_headcount_gap", """
SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(p, 0) AS planned, coalesce(a, 0) AS actual, coalesce(p, 0) - coalesce(a, 0) AS gap
FROM (SELECT c_nationkey, count(*) AS p FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS a FROM supplier GROUP BY 1)
  ON c_nationkey = s_nationkey WHERE coalesce(p, 0) <> coalesce(a, 0)""")
def fn_headcount_gap(spark: SparkSession, sf: str) -> DataFrame:
    planned = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    actual = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return fn.headcount_gap(planned, actual, ["nation"])


@query("fn_validate", """
WITH t AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS seg, c_acctbal,
  CASE WHEN c_nationkey < 5 THEN 'n' || c_nationkey ELSE CAST(c_nationkey AS VARCHAR) END AS nat,
  CASE WHEN c_nationkey < 12 THEN '31/0' || (1 + c_nationkey % 9) || '/2024' END AS dat, CASE c_nationkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'N' END AS box FROM customer)
SELECT c_custkey, 'segment is required' AS issue FROM t WHERE seg = ''
UNION ALL SELECT c_custkey, 'segment is longer than 9' FROM t WHERE length(seg) > 9
UNION ALL SELECT c_custkey, 'balance is above 9000' FROM t WHERE c_acctbal > 9000
UNION ALL SELECT c_custkey, 'nation is not a whole number' FROM t WHERE TRY_CAST(nat AS BIGINT) IS NULL
UNION ALL SELECT c_custkey, 'nation is above 20' FROM t WHERE TRY_CAST(nat AS BIGINT) > 20
UNION ALL SELECT c_custkey, 'date is required' FROM t WHERE dat IS NULL
UNION ALL SELECT c_custkey, 'date is not a date' FROM t WHERE substring(dat, 4, 2) IN ('02', '04', '06', '09')
UNION ALL SELECT c_custkey, 'box must be S or N' FROM t WHERE box IS NULL""")
def fn_validate(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey")
    t = table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal",
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("seg"),
        F.when(n < 5, F.concat(F.lit("n"), n)).otherwise(n.cast("string")).alias("nat"),
        F.when(n < 12, F.concat(F.lit("31/0"), 1 + n % 9, F.lit("/2024"))).alias("dat"),
        F.when(n % 3 == 0, "S").when(n % 3 == 1, "N").alias("box"),
    )
    return fn.issues(
        t, "c_custkey", fn.check_text("segment", F.col("seg"), True, 9),
        fn.check_number("balance", F.col("c_acctbal"), True, 9000),
        fn.check_integer("nation", F.col("nat"), True, 20), fn.check_date("date", F.col("dat"), True),
        fn.check_box("box", F.col("box")),
    )


@query("fn_operators", """
SELECT p_partkey, p_size + 2 * 3 - 1 AS a, CAST(p_size AS DOUBLE) / 4 AS b, p_size <> 7 AND (p_size <= 10 OR p_size >= 40) AS c,
  p_type = 'promo' AS d, p_type = 'PROMO' AS e FROM part""")
def fn_operators(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    return _parts(spark, sf).select(
        "p_partkey", (s + 2 * 3 - 1).alias("a"), (s.cast("double") / 4).alias("b"),
        ((s != 7) & ((s <= 10) | (s >= 40))).alias("c"),
        (F.col("p_type") == "promo").alias("d"), (F.col("p_type") == "PROMO").alias("e"),
    )


@query("fn_cursor_loop", """
SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY o_custkey""")
def fn_cursor_loop(spark: SparkSession, sf: str) -> DataFrame:
    """The loop's counter and sum as one grouped query with bound variables."""
    return spark.sql(
        """SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {orders}
           WHERE o_orderstatus = :xStatus AND o_totalprice > :xMin GROUP BY o_custkey""",
        args={"xStatus": "F", "xMin": 100000.0}, orders=table(spark, sf, "orders"),
    )
