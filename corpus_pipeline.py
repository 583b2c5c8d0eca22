"""A corpus made ready for training: five operators of ``corpusops.llm`` one after the other.

Each stage gets all that the one before has kept. Rows with nulls in any column, empty texts, repeated rows and
extra columns are welcome: what a stage does with them is said in its docstring, and columns it does not
know pass through. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusops.llm import langid, ngram_join, packing, quality, suffix_dedup
from corpusops.llm.queries import fold, read
from corpusops.session import stored

#: Scores below these are rejected.
LANGUAGE_SCORE, QUALITY_SCORE = 0.4, 0.3
#: Tokens of a training sequence.
CAPACITY = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones among them) and texts close to no learnt language."""
    model = langid.train(docs, fold(4) != 2)
    found = langid.predict(docs, model, docs.columns, ("_lang_pred", "_lang_score"))
    return found.where((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_lang_score") >= LANGUAGE_SCORE)).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of low score. A null text is scored as an empty one; without trusted texts all stay."""
    positives = read(spark, sf_dir, "labels").where("quality = 1")
    model = quality.train(docs, positives, fold(5) != 0)
    found = quality.score(docs, model, docs.columns, "_quality_score")
    return found.where(F.col("_quality_score") >= QUALITY_SCORE).select(*docs.columns)


def named_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_name``: its doc_id, but of the texts that share a doc_id only one (the least by hash) keeps it.

    Every other gets a number from 2^62 up, made of doc_id and text, so that it is a document of its own.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.groupBy("doc_id").agg(F.min(text).alias("_least"), F.max(text).alias("_most")).where("doc_id is not null and _least < _most")
    rows = docs.join(stored(several.select(F.col("doc_id").alias("_id"), "_least"), "several"), F.col("doc_id") == F.col("_id"), "left")
    other = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    name = F.when(F.col("_least").isNull() | (F.col("_least") == text), F.col("doc_id").cast("long")).otherwise(other)
    return rows.select(*docs.columns, name.alias("_name"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id.

    Rows that share doc_id and text are one document, of which the row with the least hash over its columns stays;
    rows that share only the doc_id are documents of their own, all but one behind the others in the order of a
    group. Texts without words link with nothing and stay; so do rows without doc_id, which nobody could name
    as kept.
    """
    named = named_texts(docs)
    groups = ngram_join.jaccard_components(named.select(F.col("_name").alias("doc_id"), "text"), 5, 80)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept"))
    plain = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    first = F.row_number().over(Window.partitionBy("_name").orderBy(F.xxhash64(*plain)))
    rows = named.join(kept, F.col("_name") == F.col("_kept"), "left_semi").withColumn("_first", first).where("_first = 1")
    return rows.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 bytes and more that an earlier document holds out of the text; n_chars follows the text.

    All rows stay, also those whose text gets empty; a null text becomes empty. Part of a character at a
    cut becomes U+FFFD.
    """
    names = {c: f"_carried_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "n_chars")}
    rows = docs.select(F.col("doc_id"), F.col("text"), *[F.col(c).alias(n) for c, n in names.items()])
    cut = suffix_dedup.remove_repeats(rows, carried=list(names.values())).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[changed.get(c, F.col(names.get(c, c))).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most CAPACITY tokens with their sequence and place in it; a null text is packed as an empty one."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)
    return packing.pack(pieces, CAPACITY).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

#: SQL cannot express the classifiers; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
