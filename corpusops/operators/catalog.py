"""Lookups and counts over the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATALOG = ["domain", "context", "product", "version", "module", "routine_name"]


def get_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id).limit(1)


def catalog(chunks: DataFrame, scope: str = "all") -> DataFrame:
    """Rows per tag combination; scope is one domain or all of them."""
    mine = chunks if scope == "all" else chunks.filter(F.col("domain") == scope)
    have = [c for c in CATALOG if c in mine.columns]
    missing = [c for c in CATALOG if c not in mine.columns]
    counted = mine.groupBy(*have).agg(F.count(F.lit(1)).alias("total"))
    full = counted.select(*have, *[F.lit(None).cast("string").alias(c) for c in missing], "total")
    return full.select(*CATALOG, "total").orderBy(*[F.asc_nulls_last(c) for c in CATALOG])


def domain_stats(chunks: DataFrame) -> DataFrame:
    """Rows per domain and, as domain '(all)', in total."""
    rolled = chunks.rollup("domain").agg(
        F.count(F.lit(1)).alias("total"), F.grouping("domain").alias("g")
    )
    return rolled.select(
        F.when(F.col("g") == 1, "(all)").otherwise(F.col("domain")).alias("domain"), "total"
    )
