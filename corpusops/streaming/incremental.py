"""Incremental ingest: new files as a stream, embedded and merged into the bucketed chunk table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.operators import buckets, ingest, reindex
from corpusops.operators.embeddings import Provider


def merge_batch(spark: SparkSession, lines: DataFrame, root: str, now: str, provider: Provider | None = None,
                n_buckets: int = buckets.BUCKETS) -> list[tuple[str, int]]:
    """One batch of lines into the table below ``root``; returns the buckets it has written.

    The batch is reduced to one row per key, embedded, and upserted into the buckets its keys fall into. A batch that
    is replayed after a failure finds its own rows and leaves the same table.
    """
    chunks = ingest.doc_chunks(ingest.doc_status(lines))
    title = F.get_json_object("metadata", "$.title")
    batch = reindex.embedded_last(chunks, "input_pos", ingest.doc_embedding_input(title), provider)
    stamp = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return buckets.merge_into(batch, root, stamp, n_buckets)


def start(spark: SparkSession, lines: DataFrame, root: str, progress: str, now: str = "", provider: Provider | None = None):
    """Start a run over the files that are there now; earlier files are not read again."""
    return (
        lines.writeStream.foreachBatch(lambda df, n: merge_batch(spark, df, root, now, provider) and None)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def run_available(spark: SparkSession, lines: DataFrame, root: str, progress: str, now: str = "", provider: Provider | None = None) -> DataFrame:
    start(spark, lines, root, progress, now, provider).awaitTermination()
    table = buckets.read(spark, root)
    if table is None:
        raise FileNotFoundError(f"no table written below {root}")
    return table.drop("bucket")
