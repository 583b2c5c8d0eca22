"""As-of reads of history tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(history: DataFrame, key: list[str], date: str, at: Column) -> DataFrame:
    """Rows of the latest date not after ``at``, per key; rows that tie on it all stay.

    The latest date is an aggregate, so a key with very many rows is reduced in every task
    before the shuffle; the join back meets one row per key on the other side.
    """
    past = history.filter(F.col(date) <= at)
    last = past.groupBy(*key).agg(F.max(date).alias(date))
    return past.join(last, [*key, date], "left_semi")


def as_of_all(base: DataFrame, key: list[str], histories: dict[str, tuple[DataFrame, str]], at: Column) -> DataFrame:
    """``base`` with the columns of several histories at one date; missing history gives nulls."""
    def add(left: DataFrame, item: tuple[str, tuple[DataFrame, str]]) -> DataFrame:
        name, (history, date) = item
        rows = as_of(history, key, date, at)
        renamed = rows.select(*key, *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in key])
        return left.join(renamed, key, "left")

    return reduce(add, histories.items(), base)
