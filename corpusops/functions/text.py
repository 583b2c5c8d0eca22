"""Text cleaning, hashing and token expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space a JavaScript trim() removes.
JS_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
)

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A filter on a column added by select() is moved below it with the whole expression in it,
    which is then computed twice. A generator that yields one row keeps it in one place.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_space(c: Column) -> Column:
    return F.trim(c, F.lit(JS_SPACE))


def collapse_whitespace(c: Column) -> Column:
    """Drop CRs and blanks before newlines, cap blank lines at one and blanks at one, trim."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "")
    c = F.regexp_replace(c, "[ \t]+\n", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, "[ \t]{2,}", " ")
    return trim_space(c)


def split_lines(c: Column) -> Column:
    return F.split(c, "\r?\n", -1)


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; no stop words, no stemming."""
    return F.filter(F.split(F.lower(c), TOKEN_BREAK, -1), lambda t: t != "")


def contains_any(c: Column, terms: list[str]) -> Column:
    """True when the upper-cased value holds any of the terms (compared upper-cased)."""
    given = [t.strip().upper() for t in terms if t.strip()]
    hit = F.lit(False)
    for t in given:
        hit = hit | F.upper(c).contains(t)
    return hit


def labelled_lines(pairs: list[tuple[str, Column]], head: str, text: Column) -> Column:
    """``label: value`` lines for the values that are set, then the text."""
    lines = [F.lit(head)] + [
        F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in pairs
    ]
    return F.concat_ws("\n", *lines, F.concat(F.lit("content:\n"), text))
