"""Readers for the file inputs: JSON lines, source trees, dumps, samples, models, golden sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusops import schemas
from corpusops.functions.text import trim_space
from corpusops.operators.layout import sniff_delimiter
from corpusops.operators.lexical import BROADCAST_ROWS
from corpusops.operators.modelkb import parse_dump
from corpusops.operators.tagging import EXTENSIONS, SKIPPED_DIRS, allowed_extension, forward_slashes
from corpusops.session import stored

GOLDEN_TOP_K = 10
MAX_TOP_K = 30


def missing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).globStatus(path):
            out.append(p)
    return out


def read_doc_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Document lines of JSONL files. A line that does not parse keeps its text in
    ``_corrupt_record``; blank lines are not rows; a missing file fails before anything is read.

    ``input_pos`` grows along the input, for "the later line wins".
    """
    gone = missing_paths(spark, paths)
    if gone:
        raise FileNotFoundError(f"document files not found: {', '.join(gone)}")
    lines = (
        spark.read.schema(schemas.DOC_LINE)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(paths)
    )
    return lines.withColumn("input_pos", _input_place(paths))


def _input_place(paths: list[str]) -> Column:
    """Grows along the input: place of the path given, file, block of the file, row of the block.

    Spark reads large blocks first, so the id of a row alone says nothing about its file.
    """
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    given = F.coalesce(*[F.when(F.startswith(path, F.lit(re.sub("^file:/*", "/", p))), i) for i, p in enumerate(paths)], F.lit(len(paths)))
    return F.struct(
        given.alias("path_no"), path.alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_tree(spark: SparkSession, roots: list[str], skipped: list[str] = SKIPPED_DIRS) -> DataFrame:
    """path, base, content of all files below the roots; skipped folders left out, a path listed
    once whatever its case (the root named first wins)."""
    parts = []
    for i, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        path = F.regexp_replace("path", "^file:/*", "/")
        parts.append(
            files.select(path.alias("path"), F.lit(root.rstrip("/")).alias("base"), "content", F.lit(i).alias("root_no"))
        )
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    below = F.split(F.lower(F.substr("path", F.length("base") + 2)), "/")
    folders = F.slice(below, 1, F.size(below) - 1)
    kept = every.filter(~F.arrays_overlap(folders, F.lit([s.lower() for s in skipped])))
    # only paths are compared; contents stay where they were read
    key = F.lower(forward_slashes(F.col("path")))
    twice = (
        kept.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("root_no", "path")).alias("first"))
        .filter("n > 1").select("k", "first")
    )
    repeated = stored(twice, "repeated")
    n = repeated.count()
    if n == 0:
        return kept.drop("root_no")
    side = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    marked = kept.withColumn("k", key).join(side, "k", "left")
    wins = F.col("first").isNull() | ((F.col("first.root_no") == F.col("root_no")) & (F.col("first.path") == F.col("path")))
    return marked.filter(wins).select("path", "base", "content")


def decode(content: Column) -> Column:
    """UTF-8 text, bad bytes replaced; null for content that holds a NUL."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(F.instr(text, "\x00") == 0, text)


def read_sources(spark: SparkSession, roots: list[str], extensions: list[str] = EXTENSIONS) -> DataFrame:
    """path, base, text and status (ready or skipped) of every file."""
    files = read_tree(spark, roots)
    wanted = allowed_extension(F.col("path"), extensions)
    text = F.when(wanted, decode(F.col("content")))
    return files.select("path", "base", text.alias("text")).withColumn(
        "status", F.when(F.coalesce("text", F.lit("")) == "", "skipped").otherwise("ready")
    )


def read_dump(spark: SparkSession, path: str, n_columns: int = 4) -> DataFrame:
    return parse_dump(spark.read.text(path), n_columns)


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """A delimited sample, all columns as text; the delimiter is taken from its first line."""
    first = spark.read.text(path).first()
    sep = sniff_delimiter(first[0] if first else "")
    return spark.read.option("header", True).option("sep", sep).csv(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Report models, one document per file; ``name`` is the file's own name."""
    models = spark.read.option("multiLine", True).schema(schemas.REPORT_MODEL).json(path)
    return models.select("*", F.col("_metadata.file_name").alias("name"))


def golden_queries(lines: DataFrame, domain: str = "all") -> DataFrame:
    """Golden queries from text lines (``value``), defaults filled in.

    Blank lines and ``#`` comments are passed over; so are lines without a query or with a
    domain that does not exist. A line that is not JSON fails the job. Queries without an id are
    called q1, q2, ... by their place among the queries kept.

    The place is the column ``place`` (file, block, row) where lines have one, see ``read_golden``; other
    lines are taken in the order of their frame.
    """
    text = trim_space(F.col("value"))
    is_query = (F.col("line") != "") & ~F.startswith("line", F.lit("#"))
    row = F.monotonically_increasing_id()
    own = F.struct(F.lit("").alias("file"), F.shiftrightunsigned(row, 33).alias("block"), row.alias("row"))
    said = lines.select(text.alias("line"), (F.col("place") if "place" in lines.columns else own).alias("pos"))
    # the condition guards the parser itself: filters alone may be evaluated in any order
    as_row = F.from_json(F.when(is_query, F.col("line")), schemas.GOLDEN_LINE, {"mode": "FAILFAST"})
    parsed = said.filter(is_query).withColumn("q", as_row).select("pos", "q.*")
    wanted_domain = F.lower(F.coalesce(F.nullif("domain", F.lit("")), F.lit("docs")))

    def listed(*names: str) -> Column:
        given = F.coalesce(*[F.col(n) for n in names], F.array().cast("array<string>"))
        return F.filter(F.transform(given, lambda v: trim_space(F.coalesce(v, F.lit("")))), lambda v: v != "")

    kept = parsed.withColumns({"query": trim_space(F.coalesce("query", F.lit(""))), "domain": wanted_domain}).filter(
        (F.col("query") != "") & F.col("domain").isin("docs", "lsp")
    )
    if domain != "all":
        kept = kept.filter(F.col("domain") == domain)
    # numbering: rows in the blocks before the row's block, plus its place inside it; a block is read by one task
    block = ["file", "block"]
    placed = kept.withColumns({"file": F.col("pos.file"), "block": F.col("pos.block")})
    counts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*block, F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("pos.row"))
    numbered = placed.join(before, block).withColumn("no", F.col("before") + inside)
    top_k = F.least(F.lit(MAX_TOP_K), F.greatest(F.lit(1), F.coalesce(F.nullif("top_k", F.lit(0)), F.lit(GOLDEN_TOP_K))))
    return numbered.select(
        F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("q"), "no")).alias("query_id"),
        "query", "domain", top_k.alias("top_k"),
        F.lower(F.coalesce(F.nullif("priority", F.lit("")), F.lit("normal"))).alias("priority"),
        *[F.nullif(F.col(f"filters.{f}"), F.lit("")).alias(f) for f in ("context", "product", "version", "module", "routine_name")],
        listed("expected_signals_all", "expected_signals").alias("expected_signals_all"),
        listed("expected_signals_any").alias("expected_signals_any"),
        listed("expected_chunk_ids").alias("expected_chunk_ids"),
        listed("expected_source_urls").alias("expected_source_urls"),
        listed("expected_file_paths").alias("expected_file_paths"),
    )


def read_golden(spark: SparkSession, path: str | list[str], domain: str = "all") -> DataFrame:
    """Golden queries of one or more files, numbered in path order whatever order Spark reads them in."""
    lines = spark.read.text(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return golden_queries(lines.select("value", place.alias("place")), domain)


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table of a relational database; with a numeric column and its bounds, read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column and bounds:
        reader = reader.options(
            partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
    return reader.load()
