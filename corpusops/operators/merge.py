"""Keyed de-duplication, upsert and removal of stale rows on plain parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["domain", "content_hash"]


def keep_last(rows: DataFrame, order: str, key: list[str] = KEY) -> DataFrame:
    """Last row of each key by ``order``.

    An aggregate, not a window: every map task reduces its copies of a key to one row
    before the shuffle, so a text copied into a third of all rows costs one row per task.
    """
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*key, *[F.col("r")[c].alias(c) for c in rest])


def upsert(table: DataFrame, batch: DataFrame, now, key: list[str] = KEY) -> DataFrame:
    """The table after the batch: columns replaced, created_at kept, updated_at set to now.

    ``batch`` must hold one row per key (see ``keep_last``); the table does already, so the
    full outer join meets unique keys on both sides and cannot skew.
    """
    old, new = table.alias("o"), batch.alias("n")
    on = None
    for k in key:
        cond = F.col(f"o.{k}") == F.col(f"n.{k}")
        on = cond if on is None else on & cond
    fresh = F.col(f"n.{key[0]}").isNotNull()
    payload = [c for c in batch.columns if c not in (*key, "created_at", "updated_at")]
    return old.join(new, on, "full_outer").select(
        *[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key],
        *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in payload],
        F.coalesce(F.col("o.created_at"), now).alias("created_at"),
        F.when(fresh, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def drop_stale(table: DataFrame, seen: DataFrame, domain: str) -> DataFrame:
    """Rows of other domains, and rows of this domain whose hash was seen.

    An empty ``seen`` empties the domain, as a full rebuild does.
    """
    mine = table.filter(F.col("domain") == domain).join(
        seen.select("content_hash").distinct(), "content_hash", "left_semi"
    )
    others = table.filter(F.col("domain") != domain)
    return others.unionByName(mine)


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the complete versions below ``root``, oldest first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(
        s.getPath().getName()
        for s in fs.listStatus(path)
        if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    )


def complete(spark: SparkSession, path: str) -> bool:
    """Whether the folder was written to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def _name(version: int) -> str:
    return f"v{version:012d}"


def version_before(spark: SparkSession, root: str, version: int) -> str | None:
    """Folder of the newest complete version older than ``version``, or none."""
    older = [v for v in _versions(spark, root) if v < _name(version)]
    return f"{root}/{older[-1]}" if older else None


def current_path(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest complete version below ``root``, or none yet."""
    done = _versions(spark, root)
    return f"{root}/{done[-1]}" if done else None


def write_version(spark: SparkSession, rows: DataFrame, root: str, version: int | None = None) -> str:
    """Write a new version next to the one being read; a reader sees it once _SUCCESS exists.

    Re-running a version with the same number replaces its folder, so a replay after a lost
    driver leaves one copy. Earlier versions stay until their owner removes them.
    """
    if version is None:
        done = _versions(spark, root)
        version = int(done[-1][1:]) + 1 if done else 0
    target = f"{root}/{_name(version)}"
    rows.write.mode("overwrite").partitionBy("domain").parquet(target)
    return target
