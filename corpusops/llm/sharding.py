"""Contiguous shards of equal bytes, from prefix sums of per-partition totals. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.session import stored


def shard_by_bytes(rows: DataFrame, size: Column, order: list[Column], shards: int) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1), ``slot`` (gapless from 0 in its shard) and ``start``.

    The rows are put in the order of ``order`` by a range partitioning that is written once, so the
    partitions stay the same for all that follows. Each partition gives one total; the running sum of
    those totals (as many rows as partitions) gives each partition its first byte, and a window inside
    the partition gives each row its own (``start``). A row belongs to the shard in which its middle
    byte falls, so a shard differs from the equal target by less than the largest row.

    Only what the caller selects is moved: pass keys and sizes, not texts. Ties in ``order`` are put
    in any order. An empty input gives an empty result. A null size counts as 1, the smallest; a
    column named like one of the three results is replaced by it.
    """
    carried = [c for c in rows.columns if c not in ("shard", "slot", "start")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [f"_by{i}" for i in range(len(order))]
    ranged = stored(
        rows.select(
            F.struct(*carried).alias("_row_in"),
            F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1)).alias("_size"),
            *[c.alias(f"_by{i}") for i, c in enumerate(order)],
        )
        .repartitionByRange(n, *by)
        .withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(upto), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_rows_before"),
    )
    inside = Window.partitionBy("_part").orderBy(*by)
    placed = (
        ranged.withColumn("_row", F.row_number().over(inside) - 1)
        .withColumn("_upto", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn("start", F.col("_before") + F.col("_upto") - F.col("_size"))
        .withColumn("_index", F.col("_rows_before") + F.col("_row"))
        .crossJoin(F.broadcast(totals.agg(F.sum("_bytes").alias("_total"))))  # one row
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (2 * start + _size) * {shards} div (2 * _total)) as int)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "_row_in.*", "shard", (F.col("_index") - F.col("_first")).alias("slot"), "start"
    )
