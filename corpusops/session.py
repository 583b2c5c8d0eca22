"""Session construction and the few settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "corpusops", cores: int | None = None, memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench; on a cluster, submit with its own settings."""
    n = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )

#: Folders made for local applications, by application id.
_made: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may go without: there one
    fresh folder is made per application. Anywhere else a machine-local folder would be seen by one
    machine alone, so the call fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="corpusops-")
    return _made[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for results several steps need.

    A lost executor costs a re-read of files, not a re-run of what made them.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
