"""Reading of report requests: flags, categories, tables and the schema they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that set each flag of a request.
FLAG_PATTERNS = {
    "breaks": r"agrup|quebra|por\s+empresa|por\s+depart|por\s+filial|group",
    "totals": r"total|soma|contagem|count|sum|média|average",
    "rules": r"filtro|where|condição|demitido|ativo|situação|históric",
    "multi_detail": r"dependente|filho|cônjuge|master.*detail|mestre.*detalhe",
    "landscape": r"paisagem|landscape|horizontal|muitas\s+colunas|many\s+columns",
}

# Request words and the table each one points to.
TABLE_WORDS = {
    "funcionário": "R034FUN", "funcionario": "R034FUN", "employee": "R034FUN", "colaborador": "R034FUN",
    "empresa": "R030EMP", "company": "R030EMP",
    "departamento": "R018DEP", "department": "R018DEP",
    "cargo": "R024CAR", "position": "R024CAR", "job": "R024CAR",
    "salário": "R044CAL", "salario": "R044CAL", "salary": "R044CAL", "remuneração": "R044CAL",
    "dependente": "R036DEP", "dependent": "R036DEP",
    "benefício": "R163CRE", "beneficio": "R163CRE", "benefit": "R163CRE",
    "férias": "R038AFA", "ferias": "R038AFA", "vacation": "R038AFA",
    "situação": "R010SIT", "situacao": "R010SIT", "status": "R010SIT",
    "lotação": "R016HIE", "lotacao": "R016HIE",
    "escala": "R006ESC", "schedule": "R006ESC",
    "sindicato": "R012SIN", "union": "R012SIN",
    "organograma": "R032OEM", "org chart": "R032OEM",
    "evento": "R008EVC", "event": "R008EVC",
    "movimento": "R044MOV", "payroll movement": "R044MOV",
    "holerite": "R044MOV", "payslip": "R044MOV",
    "treinamento": "R040TRE", "training": "R040TRE",
    "filial": "R030FIL", "branch": "R030FIL",
    "centro de custo": "R018CCU", "cost center": "R018CCU",
}


def flags(text: Column, patterns: dict[str, str] = FLAG_PATTERNS) -> dict[str, Column]:
    return {name: text.rlike(f"(?is){p}") for name, p in patterns.items()}


def categories(breaks: Column, totals: Column, rules: Column, multi_detail: Column) -> Column:
    """Report categories of a request; several details rule out everything else."""
    base = (
        F.when(breaks & totals, F.array(F.lit("break-report"), F.lit("total-report")))
        .when(breaks, F.array(F.lit("break-report")))
        .when(totals, F.array(F.lit("total-report")))
        .otherwise(F.array(F.lit("simple-list")))
    )
    ruled = F.when(rules, F.concat(base, F.array(F.lit("complex-rules")))).otherwise(base)
    return F.when(multi_detail, F.array(F.lit("multi-detail"))).otherwise(ruled)


def table_hits(text: Column, words: dict[str, str] = TABLE_WORDS) -> Column:
    """Tables of all dictionary words in the text, in dictionary order, repeats kept.

    The dictionary is a literal looked through inside the row; there is no join.
    """
    entries = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t")) for w, t in words.items()])
    found = F.transform(
        F.array(F.lower(text)),
        lambda low: F.transform(F.filter(entries, lambda e: F.contains(low, e["w"])), lambda e: e["t"]),
    )
    return found[0]


def rank_patterns(patterns: DataFrame, wanted: Column) -> DataFrame:
    """Patterns that share tables with the request, most shared first."""
    scored = patterns.withColumn("overlap", F.size(F.array_intersect("tables", wanted)).cast("long"))
    return scored.filter(F.col("overlap") > 0).orderBy(F.desc("overlap"), "pattern")


def schema_scope(kb: DataFrame, wanted: list[str]) -> DataFrame:
    """Requested tables and those commonly joined with them, with trimmed fields."""
    asked = kb.filter(F.col("table").isin(wanted))
    scope = asked.select(F.explode(F.concat(F.array("table"), "common_joins")).alias("table")).distinct()
    trimmed = F.transform_values(
        "fields", lambda _, v: F.struct(v["type"].alias("type"), v["description"].alias("desc"))
    )
    return kb.join(scope, "table", "left_semi").select("table", "description", trimmed.alias("fields"))
