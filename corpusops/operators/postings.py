"""A stored word index: where each word stands in each chunk, and the text search that reads it instead of the texts.

The index is two Parquet tables below one folder. ``words`` holds, per word and stretch of chunks, the ids of the chunks that
hold the word and its places in each; each task writes the words of its own chunks into one file, sorted, and nothing
is shuffled. ``counts`` has one row per word with the number of chunks that hold it. A search skips, by the files' own
ranges, all that lies between its words. A word that every chunk holds is in every file, so it is spread like the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.functions.text import bind, words
from corpusops.operators.lexical import BROADCAST_ROWS, clauses, covers
from corpusops.session import stored

#: Words of text that are put together.
STRETCH = 1_000_000
#: Words of a search up to which they are also named to the reader, so that it skips row groups; beyond it the join alone selects.
NAMED_WORDS = 1000
#: Rarest words of a clause that a chunk must hold before its other words are looked at.
ANCHORS = 3


@dataclass(frozen=True)
class WordIndex:
    words: DataFrame  # word, chunks, ids, times, places
    counts: DataFrame  # word, chunks


def _packed(most: int):
    """Per word of at most ``most`` words of text: the chunks that hold it, how often each does, and the places.

    Words are numbered by Arrow; a stable sort by (word, row) puts a word's chunks and places in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(whole.column("found")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                seen = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, seen + most, side="right")))
                batch, at = whole.slice(at, to - at), to
                lists = batch.column("found")
                row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                if not len(row):
                    continue
                flat = pc.list_flatten(lists).dictionary_encode()
                code = flat.indices.to_numpy().astype(np.int64)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                key = code * batch.num_rows + row
                order = np.argsort(key, kind="stable")
                heads = np.flatnonzero(np.diff(key[order], prepend=-1))  # of a word in a chunk
                word = code[order[heads]]
                begins = np.flatnonzero(np.diff(word, prepend=-1))  # of a word
                bounds = np.append(begins, len(heads)).astype(np.int32)
                ids = batch.column("chunk_id").take(pa.array(row[order[heads]]))
                times = pa.array(np.diff(np.append(heads, len(order))).astype(np.int32))
                in_places = np.append(heads[begins], len(order)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.dictionary.take(pa.array(word[begins])),
                        pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), ids),
                        pa.ListArray.from_arrays(pa.array(bounds), times),
                        pa.ListArray.from_arrays(pa.array(in_places), pa.array(place[order].astype(np.int32))),
                    ],
                    names=["word", "chunks", "ids", "times", "places"],
                )

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, chunk_id, places), one row per word and chunk, from the stored rows."""
    for batch in batches:
        ids, times, places = (batch.column(c) for c in ("ids", "times", "places"))
        word = batch.column("word").take(pc.list_parent_indices(ids))
        bounds = np.append(0, np.cumsum(pc.list_flatten(times).to_numpy())).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [word, pc.list_flatten(ids), pa.ListArray.from_arrays(pa.array(bounds), pc.list_flatten(places))],
            names=["word", "chunk_id", "places"],
        )


def write_index(chunks: DataFrame, root: str, most: int = STRETCH) -> WordIndex:
    """Index of ``chunks`` (chunk_id, text) below ``root``; chunk ids must not repeat. A null or empty text has no rows.

    The words of up to ``most`` words of text are put together inside a batch, so that a frequent word costs little more
    than its places. A task's file depends on its own chunks only, so a task that is run again replaces what it wrote.
    ``counts`` is written last, so an index with counts is complete.
    """
    spark = chunks.sparkSession
    key = chunks.schema["chunk_id"].dataType.simpleString()
    cut = chunks.select("chunk_id", words(F.col("text")).alias("found"))
    packed = cut.mapInArrow(_packed(most), f"word string, chunks int, ids array<{key}>, times array<int>, places array<int>")
    packed.sortWithinPartitions("word").write.mode("overwrite").parquet(f"{root}/words")
    counted = _stored_words(spark, root, key).groupBy("word").agg(F.sum("chunks").alias("chunks"))
    counted.sortWithinPartitions("word").write.mode("overwrite").parquet(f"{root}/counts")
    return read_index(spark, root, key)


def _stored_words(spark: SparkSession, root: str, key: str) -> DataFrame:
    layout = f"word string, chunks int, ids array<{key}>, times array<int>, places array<int>"
    return spark.read.schema(layout).parquet(f"{root}/words")


def read_index(spark: SparkSession, root: str, key: str = "string") -> WordIndex:
    """The index below ``root``; ``key`` is the type of its chunk ids."""
    return WordIndex(
        _stored_words(spark, root, key),
        spark.read.schema("word string, chunks bigint").parquet(f"{root}/counts"),
    )


def _of(table: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the asked words (word) in a table of the index, which is not shuffled while the words are few."""
    distinct = asked.select("word").distinct()
    few = [r[0] for r in distinct.limit(NAMED_WORDS + 1).collect()]
    if len(few) <= NAMED_WORDS:
        return table.where(F.col("word").isin(few))
    return table.join(F.broadcast(distinct) if distinct.count() <= BROADCAST_ROWS else distinct, "word", "left_semi")


def postings(rows: DataFrame) -> DataFrame:
    """word, chunk_id and places of stored rows of an index, one row per word and chunk."""
    key = rows.schema["ids"].dataType.elementType.simpleString()
    return rows.select("word", "ids", "times", "places").mapInArrow(_unpacked, f"word string, chunk_id {key}, places array<int>")


def _starts(places: Column, item: Column) -> Column:
    """Places where the item's words stand next to each other, from the places of each word."""
    def of(word: Column, back: Column) -> Column:
        return F.transform(F.coalesce(F.try_element_at(places, word), F.array().cast("array<int>")), lambda p: p - back)

    rest = F.slice(F.transform(item, lambda w, j: F.struct(w.alias("w"), j.alias("j"))), 2, F.size(item))
    return F.aggregate(
        rest, of(item[0], F.lit(0)), lambda acc, x: F.when(F.size(acc) > 0, F.array_intersect(acc, of(x["w"], x["j"]))).otherwise(acc)
    )


def _score(places: Column, items: Column, forbidden: Column) -> Column:
    """Cover density of one clause from the places of its words in one chunk."""
    occurrences = F.array_sort(
        F.flatten(F.transform(items, lambda it, k: F.transform(_starts(places, it), lambda p: F.struct(p.alias("p"), k.alias("k")))))
    )
    banned = F.exists(forbidden, lambda it: F.size(_starts(places, it)) > 0)
    return F.when(banned, 0.0).otherwise(covers(occurrences, F.size(items)))


def index_matches(index: WordIndex, queries: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, text_score) of every chunk that scores above zero, as ``text_matches`` gives, without any text.

    A clause is looked up by its rarest words, ANCHORS at most. The chunks that hold these, and that ``among`` (chunk_id)
    holds if given, are written down and met with the rows of all the clause's words by (word, chunk), so a frequent word is
    spread over all tasks; while the chunks are few, rows of others go before that. What is put together in one place is
    one chunk's places of one clause's words.
    """
    wanted = stored(
        queries.select(F.col("query_id").cast("string").alias("query_id"), F.explode(clauses(F.col("text"))).alias("c"))
        .select("query_id", "c.clause", "c.items", "c.forbidden"),
        "clauses",
    )
    needed = F.array_distinct(F.flatten("items"))
    banned = F.array_except(F.array_distinct(F.flatten("forbidden")), needed)
    asked = wanted.select(
        "query_id", "clause",
        F.explode(F.concat(F.transform(needed, lambda w: F.struct(w.alias("word"), F.lit(True).alias("need"))),
                           F.transform(banned, lambda w: F.struct(w.alias("word"), F.lit(False).alias("need"))))).alias("t"),
    ).select("query_id", "clause", "t.word", "t.need")
    known = asked.join(_of(index.counts, asked), "word", "left")
    by_count = F.struct(F.coalesce("chunks", F.lit(0)).alias("chunks"), "word")
    rarest = known.where("need").groupBy("query_id", "clause").agg(
        F.slice(F.sort_array(F.collect_list(by_count)), 1, ANCHORS).alias("rarest"), F.count(F.lit(1)).alias("n_words")
    )
    anchors = stored(
        rarest.where(F.get("rarest", F.lit(0))["chunks"] > 0).select(
            "query_id", "clause", F.explode("rarest.word").alias("word"), F.size("rarest").alias("n_anchors"), "n_words"
        ),
        "anchors",
    )
    found = (
        postings(_of(index.words, anchors)).select("word", "chunk_id").join(anchors, "word")
        .groupBy("query_id", "clause", "chunk_id").agg(F.count(F.lit(1)).alias("got"), F.first("n_anchors").alias("n_anchors"), F.first("n_words").alias("n_words"))
        .where("got = n_anchors").drop("got", "n_anchors")
    )
    if among is not None:
        found = found.join(among.select("chunk_id"), "chunk_id", "left_semi")
    candidates = stored(found, "candidates")
    rows = postings(_of(index.words, asked))
    if candidates.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(candidates.select("chunk_id").distinct()), "chunk_id", "left_semi")
    wants = candidates.join(asked.select("query_id", "clause", "word", "need"), ["query_id", "clause"])
    meeting = rows.join(wants, ["word", "chunk_id"])
    together = meeting.groupBy("query_id", "clause", "chunk_id").agg(
        F.count_if("need").alias("got"), F.first("n_words").alias("n_words"), F.collect_list(F.struct("word", "places")).alias("found")
    ).where("got = n_words")
    scored = together.join(wanted, ["query_id", "clause"]).select(
        "query_id", "chunk_id",
        bind(F.map_from_entries("found"), lambda m: _score(m, F.col("items"), F.col("forbidden"))).alias("s"),
    )
    return scored.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("text_score")).where("text_score > 0")


def index_words(index: WordIndex) -> DataFrame:
    """word, chunks, places: in how many chunks a word stands and how often in all."""
    return index.words.groupBy("word").agg(
        F.sum("chunks").alias("chunks"), F.sum(F.size("places").cast("long")).alias("places")
    )
