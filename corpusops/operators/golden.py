"""Synthesis of golden queries from the chunk table."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.functions.text import blank_to_null, trim_space

MAX_QUERIES = 200

# Words that never become a signal.
STOP_WORDS = [
    "de", "da", "do", "das", "dos", "e", "ou", "em", "para", "com", "no", "na", "nos", "nas",
    "a", "o", "as", "os", "um", "uma", "como", "que", "por", "ao", "se", "sobre", "manual",
    "pagina", "home", "index",
]

MARKS = range(0x300, 0x370)
KEPT = set("abcdefghijklmnopqrstuvwxyz0123456789_./-")


@functools.cache
def _unaccented() -> tuple[str, str]:
    """Letters whose canonical decomposition is a kept character and marks, then all that is nothing but marks; the
    characters the former become."""
    letters, gone = {}, []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if ord(x) not in MARKS)
        if plain in KEPT:
            letters[c] = plain
        elif not plain:
            gone.append(c)
    return "".join([*letters, *gone]), "".join(letters.values())


def fold(c: Column) -> Column:
    """Lower case without accents; everything but [a-z0-9_./-] becomes a blank.

    Accents are the combining marks U+0300 to U+036F of the canonical decomposition. All other characters of a
    decomposition become blanks just like the character itself, so a table of single characters says all of it.
    """
    letters, plain = _unaccented()
    low = F.lower(c)
    ascii_only = F.octet_length(low) == F.length(low)
    return F.trim(F.regexp_replace(F.when(ascii_only, low).otherwise(F.translate(low, letters, plain)), "[^a-z0-9_./-]+", " "))


def signal_tokens(c: Column) -> Column:
    return F.filter(
        F.split(fold(F.coalesce(c, F.lit(""))), " +"),
        lambda t: (F.length(t) >= 4) & ~t.isin(STOP_WORDS),
    )


def signals(parts: list[Column], limit: int = 3) -> Column:
    """First distinct tokens over the parts, in order of appearance."""
    return F.slice(F.array_distinct(F.flatten(F.array(*[signal_tokens(p) for p in parts]))), 1, limit)


def heading_topic(heading: Column, title: Column) -> Column:
    h = trim_space(F.coalesce(heading, F.lit("")))
    pieces = F.filter(F.transform(F.split(h, ">"), trim_space), lambda s: s != "")
    last = F.when(h.contains(">") & (F.size(pieces) > 0), F.element_at(pieces, -1))
    return F.coalesce(last, blank_to_null(h), trim_space(F.coalesce(title, F.lit(""))))


def file_stem(path: Column) -> Column:
    base = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return trim_space(F.regexp_replace(F.regexp_replace(base, r"(?i)\.[a-z0-9]+$", ""), "[_-]+", " "))


def eligible_docs(chunks: DataFrame, min_text: int = 220) -> DataFrame:
    """Rows a question can be made of; ``docs_order`` is their reading order."""
    return chunks.filter(
        (F.col("domain") == "docs")
        & (F.coalesce(F.col("source_url"), F.lit("")) != "")
        & (F.coalesce(F.col("title"), F.lit("")) != "")
        & (F.length("text") >= min_text)
    )


def docs_order() -> list[Column]:
    return [F.asc_nulls_last("context"), F.asc_nulls_last("product"), F.col("source_url"), F.desc(F.length("text")), F.col("chunk_id")]


def eligible_sources(chunks: DataFrame, min_text: int = 180) -> DataFrame:
    return chunks.filter(
        (F.col("domain") == "lsp") & (F.coalesce(F.col("file_path"), F.lit("")) != "")
        & (F.length("text") >= min_text)
    )


def round_robin(rows: DataFrame, group: Column, source: str, wanted: int, order: list[Column], key: str = "chunk_id") -> DataFrame:
    """Up to ``wanted`` rows, one per group in turn, no source twice. ``key`` names a row.

    Only keys and what they are ordered by are ranked; texts are fetched for the rows that are taken. Sources are
    reduced by an aggregate; in a group only its first ``wanted`` rows can be taken, so the rank window
    keeps that many per task before anything is shuffled.
    """
    wanted = min(MAX_QUERIES, wanted)
    by = [f"_by{i}" for i in range(len(order))]
    keys = rows.select(source, key, group.alias("grp"), *[c.alias(n) for c, n in zip(order, by)])
    first = keys.groupBy(source).agg(F.min_by(F.struct(key, "grp", *by), F.struct(*by, key)).alias("r")).select(source, "r.*")
    turn = Window.partitionBy("grp").orderBy(*by, source)
    taken = (
        first.withColumn("round", F.row_number().over(turn))
        .filter(F.col("round") <= wanted)
        .orderBy("round", "grp")
        .limit(wanted)
    )
    # at most MAX_QUERIES rows are left, so one task may number them and every task may hold them
    numbered = taken.withColumn("n", F.row_number().over(Window.orderBy("round", "grp"))).select(key, "grp", "round", "n")
    return rows.join(F.broadcast(numbered), key)


def priority(n: Column, wanted: int) -> Column:
    return F.when(n <= max(5, wanted * 25 // 100), "high").otherwise("normal")


def question_id(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-auto-"), F.lpad(n.cast("string"), 3, "0"))


def docs_question(topic: Column, product: Column) -> Column:
    p = F.trim(F.coalesce(product, F.lit("")))
    return F.when(
        p != "", F.concat(F.lit("Como configurar "), topic, F.lit(" no "), p, F.lit("?"))
    ).otherwise(F.concat(F.lit("Como configurar "), topic, F.lit("?")))


def source_question(topic: Column, module: Column) -> Column:
    m = F.coalesce(module, F.lit(""))
    return F.when(
        (m != "") & (m != "root"), F.concat(F.lit("No LSP, o que faz "), topic, F.lit(" no modulo "), m, F.lit("?"))
    ).otherwise(F.concat(F.lit("No LSP, o que faz "), topic, F.lit("?")))


def docs_questions(chunks: DataFrame, wanted: int) -> DataFrame:
    order = [F.col("product"), F.length("text") * -1, F.col("chunk_id")]
    rows = eligible_docs(chunks).select("source_url", "context", "product", "title", "heading_path", "text", "chunk_id")
    group = F.coalesce(blank_to_null(F.trim("context")), F.lit("geral"))
    picked = round_robin(rows, group, "source_url", wanted, order)
    topic = heading_topic(F.col("heading_path"), F.col("title"))
    return picked.select(
        question_id("docs", F.col("n")).alias("id"),
        F.lit("docs").alias("domain"),
        docs_question(topic, F.col("product")).alias("query"),
        priority(F.col("n"), wanted).alias("priority"),
        F.array("source_url").alias("expected_source_urls"),
        signals([topic, F.col("title"), F.col("text")]).alias("expected_signals_any"),
    )


def source_questions(chunks: DataFrame, wanted: int) -> DataFrame:
    order = [F.length("text") * -1, F.col("chunk_id")]
    rows = eligible_sources(chunks).select("file_path", "module", "routine_name", "text", "chunk_id")
    group = F.coalesce(blank_to_null(F.trim("module")), F.lit("root"))
    picked = round_robin(rows, group, "file_path", wanted, order)
    topic = F.coalesce(blank_to_null(F.trim("routine_name")), file_stem(F.col("file_path")))
    return picked.select(
        question_id("lsp", F.col("n")).alias("id"),
        F.lit("lsp").alias("domain"),
        source_question(topic, F.col("grp")).alias("query"),
        priority(F.col("n"), wanted).alias("priority"),
        F.array("file_path").alias("expected_file_paths"),
        signals([topic, F.col("grp"), F.col("text")]).alias("expected_signals_any"),
    )
