"""Index runs: documents and source files read, cut, keyed, tagged, embedded and merged into the chunk table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusops import schemas
from corpusops.functions.text import collapse_whitespace, once
from corpusops.operators import chunking, embeddings, ingest, merge, postings, tagging
from corpusops.operators.embeddings import Provider
from corpusops.operators.tagging import TagRule
from corpusops.session import stored

STATS = ("domain", "scanned", "indexed", "skipped", "errors")


@dataclass
class Outcome:
    """Statistics of the runs that ended, and domain and message of those that failed."""

    runs: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)


def reindex_all(jobs: dict[str, Callable[[], dict]]) -> Outcome:
    """Run the jobs, named by their domain, one after the other; one that fails stops none of the others.

    A job reads its own input, so a missing file is that job's error too. Later jobs merge into the table
    that earlier ones left.
    """
    out = Outcome()
    for domain, job in jobs.items():
        try:
            out.runs.append(job())
        except Exception as e:  # noqa: BLE001
            out.errors.append({"domain": domain, "error": str(e)})
    return out


def read_chunks(spark: SparkSession, root: str, domain: str) -> DataFrame | None:
    """The newest version of the domain's chunks below ``root``, or none yet.

    Each domain has its own line of versions, so a run rewrites no rows of the other.
    """
    path = merge.current_path(spark, f"{root}/{domain}")
    return None if path is None else spark.read.schema(schemas.CHUNK).parquet(path)


def write_words(spark: SparkSession, root: str, domain: str) -> postings.WordIndex | None:
    """Word index of the domain's newest version, beside it below ``root``; none where there is no version yet.

    It is named after the version, so a search never meets the index of other rows: until this has run for a
    new version, ``read_words`` gives none and the search reads the texts.
    """
    path = merge.current_path(spark, f"{root}/{domain}")
    if path is None:
        return None
    return postings.write_index(read_chunks(spark, root, domain), f"{root}/{domain}-words/{path.rsplit('/', 1)[1]}")


def read_words(spark: SparkSession, root: str, domain: str) -> postings.WordIndex | None:
    """The word index of the domain's newest version, or none while it is not complete."""
    path = merge.current_path(spark, f"{root}/{domain}")
    place = None if path is None else f"{root}/{domain}-words/{path.rsplit('/', 1)[1]}"
    return postings.read_index(spark, place) if place and merge.complete(spark, f"{place}/counts") else None


def embedded_last(chunks: DataFrame, order: str, embed_input: Column, provider: Provider | None) -> DataFrame:
    """Last chunk of each key by ``order``, with its embedding; without a provider the deterministic one.

    Equal keys are reduced first, so a text that repeats is embedded once.
    """
    last = merge.keep_last(chunks, order).withColumn("_input", embed_input)
    if provider is None:
        found = last.withColumn("embedding", embeddings.hash_embedding(F.col("_input")))
    else:
        found = embeddings.embed_rows(last, "_input", provider)
    return found.drop("_input")


def _merge(chunks: DataFrame, order: str, embed_input: Column, root: str, domain: str, full: bool, now: str,
           provider: Provider | None) -> None:
    """Last chunk of each key embedded and merged into the domain's next version.

    A full run leaves out the rows it has not seen, as ``drop_stale`` after ``upsert`` would, but needs the
    batch once.
    """
    spark = chunks.sparkSession
    batch = embedded_last(chunks, order, embed_input, provider).select(*[c for c in schemas.CHUNK.names if c not in ("created_at", "updated_at")])
    stamp = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    before = read_chunks(spark, root, domain)
    if before is None:
        rows = batch.withColumns({"created_at": stamp, "updated_at": stamp})
    elif full:
        since = before.select(*merge.KEY, "created_at")
        rows = batch.join(since, merge.KEY, "left").withColumns(
            {"created_at": F.coalesce("created_at", stamp), "updated_at": stamp}
        )
    else:
        rows = merge.upsert(before, batch, stamp)
    merge.write_version(spark, rows.select(*schemas.CHUNK.names), f"{root}/{domain}")


def index_documents(lines: DataFrame, root: str, full: bool = False, now: str = "", limit: int = ingest.MIN_CHARS,
                    provider: Provider | None = None) -> dict:
    """Document lines (see ``read_doc_lines``) into the chunk table below ``root``; returns the run's statistics.

    ``indexed`` counts the lines that are ready, repeats included. Without a provider the embeddings are
    the deterministic ones; a provider that fails ends the run and leaves the table as it was.
    """
    status = ingest.doc_status(lines, limit)
    title = F.get_json_object("metadata", "$.title")
    _merge(ingest.doc_chunks(status), "input_pos", ingest.doc_embedding_input(title), root, "docs", full, now, provider)
    return ingest.run_stats(status, "docs").first().asDict()


def source_rows(files: DataFrame, main: str, rules: list[TagRule], ignored_paths: list[str], ignored_terms: list[str],
                limit: int, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The files with what becomes of each before cutting, and the chunk rows of those that are ready."""
    relative = tagging.relative_path(F.col("path"), F.col("base"), F.lit(main.rstrip("/")))
    named = once(files, relative_path=relative).withColumn("text", chunking.drop_lines(F.col("text"), ignored_terms))
    empty = F.coalesce("text", F.lit("")) == ""
    ignored = tagging.path_ignored(F.col("path"), F.col("relative_path"), ignored_paths)
    status = named.withColumn("status", F.when(ignored | empty, "skipped").otherwise(F.col("status")))
    keep = ["path", "relative_path"]
    pieces = chunking.source_chunks(status.filter(F.col("status") == "ready"), keep, size, overlap)
    # the place among all pieces of the file, also the short ones
    place = F.row_number().over(Window.partitionBy(*keep).orderBy("block_no", "piece_no")) - 1
    placed = pieces.withColumn("index", place).withColumnRenamed("text", "_piece")
    long = once(placed, text=collapse_whitespace(F.col("_piece"))).filter(F.length("text") >= ingest.min_chars(limit))
    key = tagging.source_key(F.col("relative_path"), F.col("path"))
    spans = [F.col(c).cast("string") for c in ("line_start", "line_end")]
    hashed = long.withColumn("content_hash", ingest.source_chunk_hash(key, *spans, F.col("text")))
    routine = F.coalesce("routine_name", tagging.routine_from_file(F.col("relative_path")))
    tags = tagging.apply_rules(F.col("path"), F.col("relative_path"), rules, tagging.module_name(F.col("relative_path")), routine)
    tagged = hashed.withColumns(tags)
    metadata = F.struct(
        F.col("relative_path").alias("file_path"), tagging.forward_slashes(F.col("path")).alias("source_path"), "module",
        "routine_name", "context", "product", "version", "line_start", "line_end", "routine_signature",
    )
    none = F.lit(None).cast("string")
    return status, tagged.select(
        F.lit("lsp").alias("domain"), ingest.source_chunk_id(key, F.col("index").cast("string"), F.col("content_hash")).alias("chunk_id"),
        "content_hash", "text", F.to_json(metadata, {"ignoreNullFields": "false"}).alias("metadata"),
        "context", "product", "version", none.alias("source_url"), "heading_path", none.alias("last_modified"),
        none.alias("crawl_strategy"), "module", "routine_name", F.col("relative_path").alias("file_path"),
        "path", "index", "line_start", "line_end", "routine_signature",
    )


def index_sources(files: DataFrame, root: str, main: str = "", rules: list[TagRule] | None = None, full: bool = False,
                  now: str = "", limit: int = ingest.MIN_CHARS, ignored_paths: list[str] | None = None,
                  ignored_terms: list[str] | None = None, size: int = chunking.CHUNK_SIZE,
                  overlap: int = chunking.CHUNK_OVERLAP, provider: Provider | None = None) -> dict:
    """Source files (see ``read_sources``) into the chunk table below ``root``; returns the run's statistics.

    ``main`` is the base whose name is not put before its paths. ``scanned`` and ``skipped`` count files,
    ``indexed`` counts chunks. A file of which no piece is long enough counts as skipped, as the query's
    SQL has it (the reference leaves it out of all three). No file at all is an error.
    """
    status, chunks = source_rows(files, main, rules or [], ignored_paths or [], ignored_terms or [], limit, size, overlap)
    cut = stored(chunks, "source_chunks")
    scanned = status.count()
    if scanned == 0:
        raise FileNotFoundError("no source files found")
    _merge(cut, "index", ingest.source_embedding_input(), root, "lsp", full, now, provider)
    done = cut.agg(F.count(F.lit(1)).alias("indexed"), F.count_distinct("path").alias("files")).first()
    return dict(zip(STATS, ("lsp", scanned, done["indexed"], scanned - done["files"], 0)))
