"""The chunk table in hash buckets: a batch rewrites the buckets it touches and leaves all other files as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.operators.merge import KEY, upsert
from corpusops.session import stored

#: Buckets of a new table, per domain. A bucket is rewritten by one task, so a large table takes more.
BUCKETS = 64


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of buckets of the tables below ``root``; one at most, unless somebody put another there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return sorted(int(n[2:]) for n in names if n.startswith("by") and n[2:].isdigit())


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """The table below ``root`` with its column ``bucket``, or none yet."""
    found = _numbers(spark, root)
    return spark.read.parquet(f"{root}/by{found[0]}") if found else None


def merge_into(batch: DataFrame, root: str, now: Column, buckets: int = BUCKETS) -> list[tuple[str, int]]:
    """Upsert ``batch`` (one row per key, see ``keep_last``) into the table below ``root``; returns the buckets written.

    A row's bucket follows from its key, so only the buckets of the batch's rows are read, joined with it and
    written again, each by Spark's own overwrite of single partitions; the number of buckets is that of
    the table once it exists. What is merged is stored before anything is replaced. Each bucket is replaced as a
    whole, but not all of them at once: after a failure the same batch is merged again and gives the same rows.
    An empty batch writes nothing.
    """
    spark = batch.sparkSession
    found = _numbers(spark, root)
    n = found[0] if found else buckets
    new = stored(batch.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(n)).cast("int")), "batch")
    touched = [(r.domain, r.bucket) for r in new.select("domain", "bucket").distinct().collect()]  # n per domain at most
    if not touched:
        return []
    if found:
        here = F.col("domain").isin(sorted({d for d, _ in touched})) & F.col("bucket").isin(sorted({b for _, b in touched}))
        old = read(spark, root).where(here).join(F.broadcast(new.select("domain", "bucket").distinct()), ["domain", "bucket"], "left_semi")
        rows = upsert(old, new, now)
    else:
        rows = new.withColumns({"created_at": now, "updated_at": now})
    merged = stored(rows, "merged").repartition("domain", "bucket")
    target = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "bucket")
    target.parquet(f"{root}/by{n}")
    return sorted(touched)
