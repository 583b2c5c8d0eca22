"""The rule language's built-in functions as Column functions; out-parameters become results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names as the date texts spell them.
MONTHS = [
    "janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro",
    "outubro", "novembro", "dezembro",
]


def today() -> Column:
    return F.current_date()


def date_parts(d: Column) -> Column:
    return F.struct(F.day(d).alias("day"), F.month(d).alias("month"), F.year(d).alias("year"))


def make_date(day: Column, month: Column, year: Column) -> Column:
    """Null for a day that does not exist."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.try_to_date(text, "yyyy-MM-dd")


def days_in_month(month: Column, year: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def date_words(d: Column) -> Column:
    return F.concat_ws(
        " de ", F.day(d).cast("string"), F.get(F.lit(MONTHS), F.month(d) - 1), F.year(d).cast("string")
    )


def add_days(d: Column, n: Column) -> Column:
    return F.date_add(d, n)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def null_date(d: Column) -> Column:
    """The zero date is the empty date."""
    return d.isNull()


def int_to_text(n: Column) -> Column:
    return n.cast("string")


def text_to_int(s: Column) -> Column:
    return F.trim(s).try_cast("bigint")


def replace(s: Column, old: Column, new: Column) -> Column:
    return F.replace(s, old, new)


def text_length(s: Column) -> Column:
    return F.length(s)


def char_at(s: Column, pos: Column) -> Column:
    return F.substr(s, pos, F.lit(1))


def copy_text(s: Column, size: Column, start: Column) -> Column:
    return F.substr(s, start, size)


def recode(s: Column, source: str, target: str) -> Column:
    """Bytes of ``s`` in one charset read as text of another."""
    return F.decode(F.encode(s, source), target)


def char_of(code: Column) -> Column:
    return F.chr(code)


def formatted(mask: str, *values: Column) -> Column:
    return F.format_string(mask, *values)


def masked_number(n: Column, width: int, decimals: int) -> Column:
    """Fixed decimals, right-aligned in ``width``; wider values keep all digits."""
    text = F.format_number(n, decimals)
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def concat(*parts: Column) -> Column:
    """Nulls count as empty text."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def is_empty(s: Column) -> Column:
    return (s.isNull() | (s == "")).cast("int")


def rounded(n: Column, decimals: int) -> Column:
    """Half away from zero, on the decimal digits of the value."""
    return F.round(n.cast("decimal(38,10)"), decimals).cast("double")


def list_count(s: Column, sep: str) -> Column:
    return F.when(F.coalesce(s, F.lit("")) == "", 0).otherwise(F.size(F.split(s, re.escape(sep), -1)))


def list_item(s: Column, sep: str, pos: int) -> Column:
    """1-based; '' beyond the list."""
    return F.split_part(s, F.lit(sep), F.lit(pos))


def list_description(codes: DataFrame, code: str, items: DataFrame, item_code: str, text: str) -> DataFrame:
    """Text of each code; codes without an entry keep null. Spark broadcasts a small item list."""
    return codes.join(items.select(F.col(item_code).alias(code), F.col(text).alias("description")), code, "left")


def count_where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.count_if(predicate).alias("n"))


def headcount_gap(planned: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Units whose planned and actual counts differ; a side without rows counts 0."""
    p = planned.groupBy(*key).agg(F.count(F.lit(1)).alias("planned"))
    a = actual.groupBy(*key).agg(F.count(F.lit(1)).alias("actual"))
    both = p.join(a, key, "full_outer")
    zero = F.lit(0).cast("long")
    filled = both.withColumns({"planned": F.coalesce("planned", zero), "actual": F.coalesce("actual", zero)})
    return filled.filter(F.col("planned") != F.col("actual")).withColumn("gap", F.col("planned") - F.col("actual"))


def check_text(name: str, c: Column, required: bool, max_length: int) -> Column:
    return _checks(name, [
        ("is required", F.coalesce(c, F.lit("")) == "", required),
        (f"is longer than {max_length}", F.length(c) > max_length, True),
    ])


def check_number(name: str, c: Column, required: bool, maximum: float) -> Column:
    return _checks(name, [
        ("is required", c.isNull(), required),
        (f"is above {maximum:g}", c > maximum, True),
    ])


def check_integer(name: str, c: Column, required: bool, maximum: int) -> Column:
    """For text input: it must also be a whole number."""
    n = text_to_int(c)
    given = F.coalesce(c, F.lit("")) != ""
    return _checks(name, [
        ("is required", ~given, required),
        ("is not a whole number", given & n.isNull(), True),
        (f"is above {maximum}", n > maximum, True),
    ])


def check_date(name: str, c: Column, required: bool) -> Column:
    given = F.coalesce(c, F.lit("")) != ""
    return _checks(name, [
        ("is required", ~given, required),
        ("is not a date", given & F.try_to_date(c, "dd/MM/yyyy").isNull(), True),
    ])


def check_box(name: str, c: Column) -> Column:
    return _checks(name, [("must be S or N", ~F.coalesce(c.isin("S", "N"), F.lit(False)), True)])


def _checks(name: str, rules: list[tuple[str, Column, bool]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(bad, F.lit(f"{name} {text}")) for text, bad, on in rules if on])
    )


def issues(df: DataFrame, key: str, *checks: Column) -> DataFrame:
    """One row per failed check."""
    return df.select(key, F.explode(F.concat(*checks)).alias("issue"))
