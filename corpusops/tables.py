"""Loading of the given parquet tables and the chunk view built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table kept in a few small files over the cores.

    A parquet row group is read by one task, so a small one-file table would keep one core busy.
    Anything of at least one full split per core is left as it lies.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if len(df.inputFiles()) < cores and int(str(size)) < cores * (128 << 20):
        return df.repartition(cores, key)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` seen as the chunk table: lang is the context, source the product."""
    return documents(spark, sf_dir).select(
        F.lit("docs").alias("domain"),
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("lang").alias("context"),
        F.col("source").alias("product"),
        "text",
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by chunk_id; a chunk without a row here has no vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), "embedding"
    )
