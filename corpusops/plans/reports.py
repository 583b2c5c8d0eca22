"""Report queries: the ten reports over given tables seen in their shape, and name lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.operators import templates as tpl
from corpusops.operators.hierarchy import ancestor_at, tree_paths
from corpusops.plans.registry import query
from corpusops.tables import table


def hr_tables(spark: SparkSession, sf: str) -> tpl.Tables:
    """The given tables in the columns the reports ask for.

    Customers are employees of the company of their nation, parts are positions and events of
    the payroll, regions > nations > suppliers the org units, orders the calculations and
    addresses, line items the movements, events the time records.
    """
    def t(name: str) -> DataFrame:
        return table(spark, sf, name)

    def person() -> DataFrame:
        return t("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("NumEmp"), F.lit(1).alias("TipCol")
        )

    def build(name: str) -> DataFrame:
        if name == "r034fun":
            return t("customer").selectExpr(
                "c_nationkey AS NumEmp", "1 AS TipCol", "c_custkey AS NumCad", "c_name AS NomFun",
                "1 AS TabOrg", "100 + c_nationkey AS NumLoc", "1 AS EstCar", "c_custkey AS CodCar",
                "c_mktsegment AS SitAfa", "CAST(date_add(DATE'2000-01-01', CAST(c_custkey AS INT)) AS STRING) AS DatAdm",
                "c_custkey AS CodPes",
            )
        if name == "r030emp":
            return t("nation").selectExpr("n_nationkey AS NumEmp", "n_name AS NomEmp")
        if name == "r016orn":
            none = "CAST(NULL AS STRING)"
            return (
                t("region").selectExpr("1 AS TabOrg", "CAST(r_regionkey AS INT) AS NumLoc", "r_name AS NomLoc")
                .unionByName(t("nation").selectExpr("1 AS TabOrg", "100 + n_nationkey AS NumLoc", "n_name AS NomLoc"))
                .unionByName(t("supplier").selectExpr("1 AS TabOrg", "CAST(1000 + s_suppkey AS INT) AS NumLoc", "s_name AS NomLoc"))
                .selectExpr("*", "'1995-01-01' AS DatCri", f"{none} AS DatExt")
            )
        if name == "r016hie":
            return t("nation").selectExpr(
                "1 AS TabOrg", "100 + n_nationkey AS NumLoc", "CAST(n_regionkey AS INT) AS PosLoc"
            ).unionByName(t("supplier").selectExpr(
                "1 AS TabOrg", "CAST(1000 + s_suppkey AS INT) AS NumLoc", "100 + s_nationkey AS PosLoc"))
        if name == "r024car":
            return t("part").selectExpr("1 AS EstCar", "p_partkey AS CodCar", "p_name AS TitCar", "p_type AS TitRed")
        if name == "r018ccu":
            return t("supplier").selectExpr(
                "s_nationkey AS NumEmp", "s_suppkey AS CodCcu", "s_name AS NomCcu",
                "'1995-01-01' AS DatCri", "CAST(NULL AS STRING) AS DatExt",
            )
        if name == "r008evc":
            return t("part").selectExpr("1 AS TabEve", "p_partkey AS CodEve", "p_name AS DesEve")
        if name in ("r046ver", "r028pvt"):
            moves = (
                t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
                .join(t("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey"), "l_orderkey")
                .join(person(), "o_custkey")
            )
            own = ["NumEmp", "TipCol", "o_custkey AS NumCad"]
            if name == "r028pvt":
                return moves.selectExpr(*own, "l_partkey AS CodVtr", "l_extendedprice AS VlrVtr")
            return moves.selectExpr(
                *own, "1 AS TabEve", "l_partkey AS CodEve", "l_orderkey AS CodCal", "l_extendedprice AS ValEve"
            )
        if name == "r044cal":
            return t("orders").join(person(), "o_custkey").selectExpr(
                "NumEmp", "o_orderkey AS CodCal", "o_orderdate AS DatPag", "o_orderpriority AS PerRef"
            )
        if name == "r033end":
            return t("orders").selectExpr(
                "o_custkey AS CodPes", "o_orderkey AS TipEnd", "o_orderpriority AS EndRua",
                "o_orderstatus AS EndNum", "'' AS EndCpl", "o_totalprice AS CodCid", "'' AS CodBai", "'' AS EndCep",
            )
        if name == "r999usu":
            return t("customer").selectExpr(
                "c_custkey AS CodUsu", "c_name AS NomUsu", "1 AS TipCol", "c_nationkey AS NumEmp",
                "1 AS CodFil", "c_custkey AS NumCad",
            )
        if name == "r034usu":
            return t("orders").selectExpr("o_custkey AS CodUsu", "o_orderkey AS CriUsu")
        if name == "r066apu":
            return t("events").withColumnRenamed("user_id", "o_custkey").join(person(), "o_custkey").selectExpr(
                "NumEmp", "TipCol", "o_custkey AS NumCad", "ts AS DataPu", "event_id AS HorDat", "value AS TemExc",
                "event_type AS FalMar", "'' AS OriHor", "props AS ComApu",
            )
        raise KeyError(name)

    return build


@query("tpl_roster", """
SELECT c_nationkey AS NumEmp, c_custkey AS NumCad, c_name AS NomFun, e.n_name AS NomEmp, o.n_name AS NomLoc,
       p_name AS TitCar, c_mktsegment AS SitAfa, CAST(CAST(DATE '2000-01-01' + CAST(c_custkey AS INT) AS DATE) AS VARCHAR) AS DatAdm
FROM customer LEFT JOIN nation e ON e.n_nationkey = c_nationkey LEFT JOIN nation o ON 100 + o.n_nationkey = 100 + c_nationkey
LEFT JOIN part ON p_partkey = c_custkey WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 100""")
def tpl_roster(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_template(hr_tables(spark, sf), "employee-roster", numEmp=7)


@query("tpl_payroll", """
SELECT c_nationkey AS NumEmp, c_custkey AS NumCad, c_name AS NomFun, l_partkey AS CodEve, p_name AS DesEve,
       l_extendedprice AS ValEve, o_orderdate AS DatPag, o_orderpriority AS PerRef
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE c_nationkey = 1 ORDER BY DatPag DESC, NumCad, CodEve, NomFun, DesEve, ValEve, PerRef LIMIT 200""")
def tpl_payroll(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_template(hr_tables(spark, sf), "payroll-summary")


_TREE = """n(NumLoc, NomLoc) AS (SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation
  UNION ALL SELECT 1000 + s_suppkey, s_name FROM supplier),
h(NumLoc, PosLoc) AS (SELECT 100 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey FROM supplier),
tree(NumLoc, NomLoc, ParentLoc, TreeLevel, TreePath, top) AS (
  SELECT NumLoc, NomLoc, CAST(NULL AS BIGINT), 0, NomLoc, NumLoc FROM n WHERE NumLoc NOT IN (SELECT NumLoc FROM h)
  UNION ALL
  SELECT n.NumLoc, n.NomLoc, h.PosLoc, TreeLevel + 1, TreePath || ' > ' || n.NomLoc, top
  FROM h JOIN n ON n.NumLoc = h.NumLoc JOIN tree ON h.PosLoc = tree.NumLoc WHERE TreeLevel < 10)"""


@query("tpl_org_tree", f"""WITH RECURSIVE {_TREE}
SELECT 1 AS TabOrg, NumLoc, NomLoc, ParentLoc, TreeLevel, TreePath FROM tree""")
def tpl_org_tree(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_template(hr_tables(spark, sf), "org-chart")


def _org(spark: SparkSession, sf: str) -> DataFrame:
    t = hr_tables(spark, sf)
    return tree_paths(t("r016orn"), t("r016hie"), "NumLoc", "NomLoc", "NumLoc", "PosLoc")


@query("fn_tree_level", f"WITH RECURSIVE {_TREE} SELECT NumLoc AS node, TreeLevel AS level FROM tree")
def fn_tree_level(spark: SparkSession, sf: str) -> DataFrame:
    return _org(spark, sf).select("node", "level")


@query("fn_tree_ancestor", f"""WITH RECURSIVE {_TREE}
SELECT NumLoc AS node, CAST(top AS VARCHAR) AS root,
       CAST(CASE TreeLevel WHEN 1 THEN NumLoc WHEN 2 THEN ParentLoc END AS VARCHAR) AS ancestor_1 FROM tree""")
def fn_tree_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    return _org(spark, sf).select(
        "node", ancestor_at(F.col("chain"), 0).alias("root"), ancestor_at(F.col("chain"), 1).alias("ancestor_1")
    )


@query("fn_tree_code", """
SELECT s_suppkey AS node, n_name AS code FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def fn_tree_code(spark: SparkSession, sf: str) -> DataFrame:
    """The code of the unit a supplier sits in, looked up by the unit's number."""
    units = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("code"))
    return table(spark, sf, "supplier").join(units, "s_nationkey", "left").select(F.col("s_suppkey").alias("node"), "code")


@query("tpl_cost_centers", """
SELECT s_nationkey AS NumEmp, n_name AS NomEmp, s_suppkey AS CodCcu, s_name AS NomCcu, '1995-01-01' AS DatCri,
       CAST(NULL AS VARCHAR) AS DatExt FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey = 1""")
def tpl_cost_centers(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_template(hr_tables(spark, sf), "cost-centers")


@query("tpl_positions", "SELECT 1 AS EstCar, p_partkey AS CodCar, p_name AS TitCar, p_type AS TitRed FROM part")
def tpl_positions(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_template(hr_tables(spark, sf), "positions")


@query("tpl_addresses", """
SELECT c_nationkey AS NumEmp, c_custkey AS NumCad, c_name AS NomFun, o_orderkey AS TipEnd, o_orderpriority AS EndRua,
       o_orderstatus AS EndNum, '' AS EndCpl, o_totalprice AS CodCid, '' AS CodBai, '' AS EndCep
FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 1 ORDER BY c_custkey, o_orderkey LIMIT 100""")
def tpl_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_template(hr_tables(spark, sf), "employee-addresses")


@query("tpl_users", """
SELECT c_custkey AS CodUsu, c_name AS NomUsu, 1 AS TipCol, c_nationkey AS NumEmp, 1 AS CodFil, c_custkey AS NumCad,
       o_orderkey AS CriUsu FROM customer LEFT JOIN orders ON o_custkey = c_custkey ORDER BY c_custkey, o_orderkey LIMIT 100""")
def tpl_users(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_template(hr_tables(spark, sf), "user-accounts")


@query("tpl_departments", f"""WITH RECURSIVE {_TREE}
SELECT 1 AS TabOrg, n.NumLoc, n.NomLoc, '1995-01-01' AS DatCri, CAST(NULL AS VARCHAR) AS DatExt, h.PosLoc AS ParentLoc, p.NomLoc AS ParentName
FROM n LEFT JOIN h ON n.NumLoc = h.NumLoc LEFT JOIN n p ON p.NumLoc = h.PosLoc""")
def tpl_departments(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_template(hr_tables(spark, sf), "departments")


@query("tpl_benefits", """
SELECT c_nationkey AS NumEmp, c_custkey AS NumCad, c_name AS NomFun, l_partkey AS CodVtr, l_extendedprice AS VlrVtr
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_nationkey = 1 ORDER BY NumCad, NomFun, CodVtr, VlrVtr LIMIT 100""")
def tpl_benefits(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_template(hr_tables(spark, sf), "benefits-summary")


@query("tpl_time_records", """
SELECT c_nationkey AS NumEmp, c_custkey AS NumCad, c_name AS NomFun, ts AS DataPu, event_id AS HorDat, value AS TemExc,
       event_type AS FalMar, '' AS OriHor, props AS ComApu
FROM events JOIN customer ON c_custkey = user_id WHERE c_nationkey = 1 ORDER BY ts DESC, NumCad, event_id LIMIT 200""")
def tpl_time_records(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_template(hr_tables(spark, sf), "time-records")


@query("tpl_bind", """
SELECT o_orderpriority, count(*) AS orders, max(o_orderkey) AS last_order FROM orders
WHERE o_totalprice >= 200000 AND o_orderstatus = 'F' GROUP BY o_orderpriority""")
def tpl_bind(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.run_sql(
        spark,
        """SELECT o_orderpriority, count(*) AS orders, max(o_orderkey) AS last_order FROM {orders}
           WHERE o_totalprice >= :minPrice AND o_orderstatus = :status GROUP BY o_orderpriority""",
        {"minPrice": 100.0, "status": "F"}, {"MINPRICE": "200000"}, orders=table(spark, sf, "orders"),
    )


@query("tpl_batch", """
SELECT 'success' AS status, 4 AS reports, CAST(200 + 100 + (SELECT count(*) FROM part) + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS BIGINT) AS n_rows
UNION ALL SELECT 'no_output', 1, 0 UNION ALL SELECT 'error', 2, 0""")
def tpl_batch(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [
        ("payroll-summary", {"numEmp": 1}), ("user-accounts", {}), ("positions", {}), ("org-chart", {}),
        ("cost-centers", {"numEmp": 99}), ("cost-centers", {"numEmp": "x"}), ("no-such-report", {}),
    ]
    return tpl.batch_summary(tpl.run_batch(spark, hr_tables(spark, sf), wanted))


@query("cat_filter", """
SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND
  (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring'))""")
def cat_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = tpl.search_records(table(spark, sf, "part"), "Ring", "PROMO", "p_type")
    return found.select("p_partkey", "p_name")


REQUESTED = ["old rod.17", "old rod", "blue ring.5", "red", "plate.99", "zzz"]
_ASKED = ", ".join(f"('{r.upper()}')" for r in REQUESTED)


@query("reg_match", f"""
WITH reg AS (SELECT p_partkey, p_name || '.' || p_partkey AS name FROM part), a(requested) AS (VALUES {_ASKED}),
m AS (SELECT requested, p_partkey, name, CASE WHEN upper(name) = requested THEN 1 WHEN starts_with(upper(name), requested || '.') THEN 2
        WHEN contains(upper(name), requested) THEN 3 END AS tier FROM reg, a),
r AS (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY tier, name) AS rn, min(tier) OVER (PARTITION BY requested) AS best
      FROM m WHERE tier IS NOT NULL)
SELECT requested, p_partkey, name, tier, CAST(rn AS INT) AS rn FROM r WHERE rn <= 5 AND tier = best AND (tier = 3 OR rn = 1)""")
def reg_match(spark: SparkSession, sf: str) -> DataFrame:
    reg = table(spark, sf, "part").select("p_partkey", F.concat_ws(".", "p_name", "p_partkey").alias("name"))
    return tpl.match_names(reg, "name", REQUESTED)


@query("reg_group", """
SELECT c_mktsegment, count(*) AS entries, CASE c_mktsegment WHEN 'BUILDING' THEN 'bs' WHEN 'FURNITURE' THEN 'rubi'
  ELSE lower(c_mktsegment) END AS module FROM customer GROUP BY c_mktsegment""")
def reg_group(spark: SparkSession, sf: str) -> DataFrame:
    return tpl.group_registry(table(spark, sf, "customer"), "c_mktsegment", {"BUILDING": "bs", "FURNITURE": "rubi"})
