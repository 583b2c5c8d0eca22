"""Layout profile of a sample table: column types, alignment, totals and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE_SHARE = 0.5
NUMBER_SHARE = 0.7
WIDE_COLUMNS = 8
GROUP_ROWS = 50
DATE = r"\d{2}[/\-]\d{2}[/\-]\d{2,4}"

# Words that mark a totals row.
TOTAL_WORDS = ["total", "soma", "sum", "subtotal", "grand total"]


def sniff_delimiter(first_line: str, default: str = ",") -> str:
    """Tab or semicolon when the first line lacks the default; a semicolon wins over a tab."""
    chosen = default
    for other in ("\t", ";"):
        if other in first_line and chosen not in first_line:
            chosen = other
    return chosen


def is_number(c: Column) -> Column:
    """A numeric prefix is enough once currency marks, dots, commas and blanks are gone."""
    return F.regexp_replace(c, r"[R$.,\s]", "").rlike(r"^[+-]?(\d|Infinity)")


def column_profile(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: pos, header, type, align, width_pct. One pass, one aggregate."""
    names = columns or rows.columns
    aggs = []
    for c in names:
        v = F.col(c).cast("string")
        given = F.coalesce(v, F.lit("")) != ""
        aggs += [
            F.count_if(given), F.count_if(given & v.rlike(DATE)), F.count_if(given & is_number(v)),
        ]
    counted = rows.agg(*[a.alias(f"x{i}") for i, a in enumerate(aggs)])
    entries = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("pos"), F.lit(c).alias("header"),
                F.col(f"x{3 * i}").alias("n"), F.col(f"x{3 * i + 1}").alias("dates"),
                F.col(f"x{3 * i + 2}").alias("numbers"),
            )
            for i, c in enumerate(names)
        ]
    )
    kind = (
        F.when(F.col("n") == 0, "text")
        .when(F.col("dates") > F.col("n") * DATE_SHARE, "date")
        .when(F.col("numbers") > F.col("n") * NUMBER_SHARE, "number")
        .otherwise("text")
    )
    typed = counted.select(F.explode(entries).alias("e")).select("e.*").withColumn("type", kind)
    return typed.select(
        "pos", "header", "type",
        F.when(F.col("type") == "number", "right").when(F.col("type") == "date", "center").otherwise("left").alias("align"),
        F.lit(int(100 / len(names) + 0.5)).alias("width_pct"),
    )


def flags(rows: DataFrame, pos: str, cells: list[str]) -> DataFrame:
    """orientation, has_totals (a totals word in the last row) and has_grouping, in one row.

    ``pos`` counts the rows from 0; groups are looked for in the first rows only.
    """
    texts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells])
    shaped = rows.select(F.col(pos).alias("p"), texts.alias("cells"))
    filled = F.size(F.filter("cells", lambda c: c != ""))
    lone = (F.col("p") < GROUP_ROWS) & (filled == 1) & (F.get("cells", F.lit(0)) != "")
    totals = F.exists(
        "last", lambda c: F.exists(F.lit(TOTAL_WORDS), lambda w: F.contains(F.lower(c), w))
    )
    return shaped.agg(
        F.max_by("cells", "p").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(lone).alias("groups")
    ).select(
        F.lit("landscape" if len(cells) > WIDE_COLUMNS else "portrait").alias("orientation"),
        ((F.col("n") >= 2) & totals).alias("has_totals"),
        (F.col("groups") >= 2).alias("has_grouping"),
        F.lit(len(cells)).alias("total_columns"),
        F.col("n").alias("total_rows"),
    )
