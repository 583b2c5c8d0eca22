"""The ten parameterised reports, their parameters, batch runs and name lookups.

Each report is a function of its tables (name -> DataFrame) and bound parameters. TOP n reports
sort by the report's own keys and then by every other output column, so that n rows are n
determined rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusops.operators.hierarchy import tree_paths

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Template:
    id: str
    build: Callable[..., DataFrame]
    tables: tuple[str, ...]
    params: dict[str, object] = field(default_factory=dict)


def _top(df: DataFrame, n: int, *keys) -> DataFrame:
    named = [k for k in keys if isinstance(k, str)]
    rest = [c for c in df.columns if c not in named]
    return df.orderBy(*keys, *rest).limit(n)


def employee_roster(t: Tables, numEmp: int) -> DataFrame:
    f = t("r034fun").filter(F.col("NumEmp") == numEmp)
    rows = (
        f.join(t("r030emp"), "NumEmp", "left")
        .join(t("r016orn").select("TabOrg", "NumLoc", "NomLoc"), ["TabOrg", "NumLoc"], "left")
        .join(t("r024car").select("EstCar", "CodCar", "TitCar"), ["EstCar", "CodCar"], "left")
    )
    out = rows.select("NumEmp", "NumCad", "NomFun", "NomEmp", "NomLoc", "TitCar", "SitAfa", "DatAdm")
    return _top(out, 100, "NumCad")


def payroll_summary(t: Tables, numEmp: int) -> DataFrame:
    person = ["NumEmp", "TipCol", "NumCad"]
    mine = F.col("NumEmp") == numEmp
    rows = (
        t("r034fun").filter(mine).select(*person, "NomFun")
        .join(t("r046ver").filter(mine), person)
        .join(t("r008evc"), ["TabEve", "CodEve"])
        .join(t("r044cal").filter(mine), ["NumEmp", "CodCal"])
    )
    out = rows.select("NumEmp", "NumCad", "NomFun", "CodEve", "DesEve", "ValEve", "DatPag", "PerRef")
    return _top(out, 200, F.desc("DatPag"), "NumCad", "CodEve")


def org_chart(t: Tables, tabOrg: int) -> DataFrame:
    nodes = t("r016orn").filter(F.col("TabOrg") == tabOrg)
    links = t("r016hie").filter(F.col("TabOrg") == tabOrg)
    tree = tree_paths(nodes, links, "NumLoc", "NomLoc", "NumLoc", "PosLoc")
    return tree.select(
        F.lit(tabOrg).alias("TabOrg"), F.col("node").alias("NumLoc"), F.col("name").alias("NomLoc"),
        F.col("parent").alias("ParentLoc"), F.col("level").alias("TreeLevel"),
        F.col("path").alias("TreePath"),
    ).orderBy("TreePath", "NumLoc")


def cost_centers(t: Tables, numEmp: int) -> DataFrame:
    rows = t("r018ccu").filter(F.col("NumEmp") == numEmp).join(t("r030emp"), "NumEmp", "left")
    return rows.select("NumEmp", "NomEmp", "CodCcu", "NomCcu", "DatCri", "DatExt").orderBy("CodCcu")


def positions(t: Tables) -> DataFrame:
    return t("r024car").select("EstCar", "CodCar", "TitCar", "TitRed").orderBy("EstCar", "CodCar")


def employee_addresses(t: Tables, numEmp: int) -> DataFrame:
    f = t("r034fun").filter(F.col("NumEmp") == numEmp).select("NumEmp", "NumCad", "NomFun", "CodPes")
    out = f.join(t("r033end"), "CodPes").select(
        "NumEmp", "NumCad", "NomFun", "TipEnd", "EndRua", "EndNum", "EndCpl", "CodCid", "CodBai", "EndCep"
    )
    return _top(out, 100, "NumCad", "TipEnd")


def user_accounts(t: Tables) -> DataFrame:
    out = t("r999usu").join(t("r034usu"), "CodUsu", "left").select(
        "CodUsu", "NomUsu", "TipCol", "NumEmp", "CodFil", "NumCad", "CriUsu"
    )
    return _top(out, 100, "CodUsu")


def departments(t: Tables, tabOrg: int) -> DataFrame:
    o = t("r016orn").filter(F.col("TabOrg") == tabOrg)
    links = t("r016hie").filter(F.col("TabOrg") == tabOrg).select("NumLoc", F.col("PosLoc").alias("ParentLoc"))
    parents = o.select(F.col("NumLoc").alias("ParentLoc"), F.col("NomLoc").alias("ParentName"))
    return (
        o.join(links, "NumLoc", "left").join(parents, "ParentLoc", "left")
        .select("TabOrg", "NumLoc", "NomLoc", "DatCri", "DatExt", "ParentLoc", "ParentName")
        .orderBy("NumLoc", "ParentLoc")
    )


def benefits_summary(t: Tables, numEmp: int) -> DataFrame:
    person = ["NumEmp", "TipCol", "NumCad"]
    mine = F.col("NumEmp") == numEmp
    rows = t("r034fun").filter(mine).select(*person, "NomFun").join(t("r028pvt").filter(mine), person)
    return _top(rows.select("NumEmp", "NumCad", "NomFun", "CodVtr", "VlrVtr"), 100, "NumCad")


def time_records(t: Tables, numEmp: int) -> DataFrame:
    person = ["NumEmp", "TipCol", "NumCad"]
    mine = F.col("NumEmp") == numEmp
    rows = t("r034fun").filter(mine).select(*person, "NomFun").join(t("r066apu").filter(mine), person)
    out = rows.select("NumEmp", "NumCad", "NomFun", "DataPu", "HorDat", "TemExc", "FalMar", "OriHor", "ComApu")
    return _top(out, 200, F.desc("DataPu"), "NumCad")


TEMPLATES = {
    t.id: t
    for t in (
        Template("employee-roster", employee_roster, ("r034fun", "r030emp", "r016orn", "r024car"), {"numEmp": 1}),
        Template("payroll-summary", payroll_summary, ("r034fun", "r046ver", "r008evc", "r044cal"), {"numEmp": 1}),
        Template("org-chart", org_chart, ("r016orn", "r016hie"), {"tabOrg": 1}),
        Template("cost-centers", cost_centers, ("r018ccu", "r030emp"), {"numEmp": 1}),
        Template("positions", positions, ("r024car",)),
        Template("employee-addresses", employee_addresses, ("r034fun", "r033end"), {"numEmp": 1}),
        Template("user-accounts", user_accounts, ("r999usu", "r034usu")),
        Template("departments", departments, ("r016orn", "r016hie"), {"tabOrg": 1}),
        Template("benefits-summary", benefits_summary, ("r034fun", "r028pvt"), {"numEmp": 1}),
        Template("time-records", time_records, ("r034fun", "r066apu"), {"numEmp": 1}),
    )
}


class MissingParameter(ValueError):
    pass


def bind(declared: dict[str, object], given: dict[str, object]) -> dict[str, object]:
    """Given value by name, whatever its case, else the default; neither is an error."""
    by_name = {k.lower(): v for k, v in given.items()}
    out = {}
    for name, default in declared.items():
        value = by_name.get(name.lower(), default)
        if value is None:
            raise MissingParameter(f"missing required parameter: {name}")
        out[name] = type(default)(value) if default is not None else value
    return out


def run_template(t: Tables, template_id: str, **given) -> DataFrame:
    template = TEMPLATES[template_id]
    return template.build(t, **bind(template.params, given))


def run_sql(spark: SparkSession, text: str, declared: dict[str, object], given: dict[str, object],
            **frames: DataFrame) -> DataFrame:
    """SQL with ``:name`` markers; values are bound as typed literals, never pasted into the text."""
    return spark.sql(text, args=bind(declared, given), **frames)


def run_batch(spark: SparkSession, t: Tables, requests: list[tuple[str, dict]]) -> DataFrame:
    """Outcome of each requested report: success, no_output or error, and its row count."""
    outcomes = []
    for template_id, given in requests:
        try:
            n = run_template(t, template_id, **given).count()
            outcomes.append((template_id, "success" if n else "no_output", n))
        except (KeyError, ValueError, TypeError):
            outcomes.append((template_id, "error", 0))
    return spark.createDataFrame(outcomes, "template string, status string, n_rows bigint")


def batch_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("reports"), F.sum("n_rows").alias("n_rows"))


def search_records(rows: DataFrame, text: str, module: str | None = None, module_col: str = "module") -> DataFrame:
    """Records whose JSON text holds ``text``, whatever its case; optionally of one module."""
    found = F.contains(F.lower(F.to_json(F.struct(*rows.columns))), F.lit(text.lower()))
    return rows.filter(found if module is None else (F.col(module_col) == module) & found)


def match_names(registry: DataFrame, name: str, requested: list[str], suggestions: int = 5) -> DataFrame:
    """For each requested name: its exact entry, else the first with an extension, else
    up to five entries that contain it.

    The requested names are a literal list checked inside the row, so the registry is scanned
    once; the rank window keeps at most five rows per name and task before the shuffle.
    """
    asked = F.lit([r.upper() for r in requested])
    upper = F.upper(F.col(name))

    def tier(r: Column) -> Column:
        return (
            F.when(upper == r, 1)
            .when(F.startswith(upper, F.concat(r, F.lit("."))), 2)
            .when(F.contains(upper, r), 3)
        )

    hits = F.filter(
        F.transform(asked, lambda r: F.struct(r.alias("requested"), tier(r).alias("tier"))),
        lambda h: h["tier"].isNotNull(),
    )
    order = Window.partitionBy("requested").orderBy("tier", name)
    ranked = (
        registry.select(*registry.columns, F.explode(hits).alias("h"))
        .select(*registry.columns, "h.requested", "h.tier")
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= suggestions)
    )
    best = Window.partitionBy("requested")
    return (
        ranked.withColumn("best", F.min("tier").over(best))
        .filter((F.col("tier") == F.col("best")) & ((F.col("tier") == 3) | (F.col("rn") == 1)))
        .drop("best")
    )


def group_registry(registry: DataFrame, system: str, modules: dict[str, str]) -> DataFrame:
    """Entries per system and the module its code stands for (its lower-cased code if unknown)."""
    named = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in modules.items() for x in kv]), F.col(system)),
        F.lower(system),
    )
    return registry.groupBy(system).agg(F.count(F.lit(1)).alias("entries")).withColumn("module", named)
