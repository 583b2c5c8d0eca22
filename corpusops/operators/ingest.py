"""Cleaning, keys, metadata and run statistics of the document ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.functions.text import blank_to_null, collapse_whitespace, labelled_lines, once

MIN_CHARS = 50
MIN_CHARS_FLOOR = 20


def min_chars(limit: int = MIN_CHARS) -> int:
    return max(MIN_CHARS_FLOOR, limit)


def content_hash(given: Column, text: Column) -> Column:
    return F.coalesce(blank_to_null(given), F.sha1(text))


def doc_chunk_id(given: Column, source_url: Column, hash_: Column) -> Column:
    made = F.sha1(F.concat_ws("::", F.coalesce(source_url, F.lit("")), hash_))
    return F.coalesce(blank_to_null(given), made)


def source_chunk_hash(key: Column, start: Column, end: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws(":", key, start, end, text))


def source_chunk_id(key: Column, index: Column, hash_: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("::", F.lit("lsp"), key, index, hash_)), 1, 32)


_METADATA_TEXT = ["title", "source_root", "source_url", "context", "product", "version", "heading_path"]


def doc_metadata(row: DataFrame) -> Column:
    """Seven fields keep '' when absent, the last two become null."""
    return F.struct(
        *[F.coalesce(row[c], F.lit("")).alias(c) for c in _METADATA_TEXT],
        blank_to_null(row["last_modified"]).alias("last_modified"),
        blank_to_null(row["crawl_strategy"]).alias("crawl_strategy"),
    )


def doc_status(lines: DataFrame, limit: int = MIN_CHARS) -> DataFrame:
    """Cleaned text and what becomes of each line: error, skipped or ready."""
    cleaned = once(lines.withColumnRenamed("text", "_raw"), text=collapse_whitespace(F.col("_raw"))).drop("_raw")
    return cleaned.withColumn(
        "status",
        F.when(F.col("_corrupt_record").isNotNull(), "error")
        .when(F.length("text") < min_chars(limit), "skipped")
        .otherwise("ready"),
    )


def doc_chunks(status: DataFrame) -> DataFrame:
    """Chunk rows of the lines that are ready."""
    ready = status.filter(F.col("status") == "ready")
    hashed = ready.withColumn("content_hash", content_hash(F.col("content_hash"), F.col("text")))
    keyed = hashed.withColumn(
        "chunk_id", doc_chunk_id(F.col("chunk_id"), F.col("source_url"), F.col("content_hash"))
    )
    optional = ["context", "product", "version", "source_url", "heading_path", "last_modified",
                "crawl_strategy"]
    return keyed.select(
        F.lit("docs").alias("domain"),
        "chunk_id",
        "content_hash",
        "text",
        F.to_json(doc_metadata(keyed), {"ignoreNullFields": "false"}).alias("metadata"),
        *[blank_to_null(F.col(c)).alias(c) for c in optional],
        F.lit(None).cast("string").alias("module"),
        F.lit(None).cast("string").alias("routine_name"),
        F.lit(None).cast("string").alias("file_path"),
        *[c for c in ("input_pos",) if c in keyed.columns],
    )


def doc_embedding_input(title: Column) -> Column:
    c = F.col
    return labelled_lines(
        [("context", c("context")), ("product", c("product")), ("version", c("version")),
         ("title", title), ("heading", c("heading_path")), ("source_url", c("source_url"))],
        "domain: docs",
        c("text"),
    )


def source_embedding_input() -> Column:
    c = F.col
    return labelled_lines(
        [("module", c("module")), ("routine", c("routine_name")), ("file_path", c("file_path")),
         ("line_start", c("line_start").cast("string")), ("line_end", c("line_end").cast("string")),
         ("routine_signature", c("routine_signature")), ("context", c("context")),
         ("product", c("product")), ("version", c("version"))],
        "domain: lsp",
        c("text"),
    )


def run_stats(status: DataFrame, domain: str) -> DataFrame:
    """One row: lines seen, rows ready (repeats included), skipped and failed."""
    return status.agg(
        F.lit(domain).alias("domain"),
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("status") == "ready").alias("indexed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
