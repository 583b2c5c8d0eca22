"""Removal of repeated runs of words, by fixed-block anchors.

Every document is a reference: its words are cut into non-overlapping blocks of a length such that any window
holds a whole block of the document it stands in. The blocks are indexed, and every document probes the index
with all its rolling windows of a block's length. So two equal windows always share a hit: a block of the one
stands in the other at the same place. A hit is then grown to both sides: for each way to lay a window
around it, the window's words are asked for a second time, and equal ones are told apart by who stands first.
Runs of windows that an earlier one equals make up the maximal repeats.

No pairs of places are formed. A slice of the corpus asks for each distinct run of words once, so a passage that
all documents hold costs one entry per slice, and the slice with the smallest doc_id is the answer for all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from corpusops.llm import exchange
from corpusops.llm.words import joined, rolled, word_hashes, word_spans
from corpusops.session import stored

#: Bits of a block's fingerprint above those of the corpus's size in bytes; agreement by chance only costs time.
SPARE_BITS = 10
#: Bases of the fingerprints of blocks and of windows, and of the windows' second fingerprint.
BLOCK, WINDOW, SECOND = 101, 202, 303
#: What goes with a window's key: the smallest doc_id of the slice that holds it and its second fingerprint.
FIRST = np.dtype([("id", "<i8"), ("check", "<u4")])


def block_length(window: int) -> int:
    """The longest block of which any ``window`` words in a row hold a whole one."""
    return max(1, (window + 1) // 2)


class Words:
    """The words of a slice."""

    def __init__(self, table: pa.Table) -> None:
        self.ids, self.offsets, self.data = exchange.documents(table)
        self.begins, self.ends, self.counts = word_spans(self.data, self.offsets)
        self.hashes = word_hashes(self.data, self.begins, self.ends)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        first = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(self.doc)) - first[self.doc]  # in its document

    def starts(self, width: int) -> np.ndarray:
        """Whether ``width`` words of one document begin at a word."""
        return self.place + width <= self.counts[self.doc]


def blocks(words: Words, window: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The probes: their places, their distinct keys, each probe's place among these, and whether it is a block."""
    size = block_length(window)
    at = np.flatnonzero(words.starts(size) & (words.counts[words.doc] >= window))
    keys, place = exchange.distinct(exchange.leading(rolled(words.hashes, size, BLOCK)[at], total, SPARE_BITS))
    return at, keys, place, words.place[at] % size == 0


def in_index(values: np.ndarray, place: np.ndarray, indexed: np.ndarray) -> np.ndarray:
    """For each slice's entry whether the run is a block of another slice, or its own block is probed by another."""
    held = np.bincount(place, minlength=len(values))
    of_index = np.bincount(place, weights=indexed, minlength=len(values))
    return (of_index[place] > 0) & (held[place] > 1)


def around_hits(words: Words, window: int, total: int, answers: pa.Table) -> np.ndarray:
    """Marks the places where a window begins that holds a hit."""
    at, keys, place, block = blocks(words, window, total)
    hit = exchange.found(answers, "?") if len(keys) else np.empty(0, bool)
    times = np.bincount(place, minlength=len(keys))
    hit |= (times > 1) & (np.bincount(place, weights=block, minlength=len(keys)) > 0)  # inside the slice
    hits = at[hit[place]] if len(at) else at
    return covered(np.maximum(hits - (window - block_length(window)), 0), hits + 1, len(words.doc)) & words.starts(window)


def covered(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges a to b - 1."""
    steps = np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def told_apart(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in the order of ``keys``: a member of each, and every entry's place among them."""
    order = np.lexsort((check, keys))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(check[order]) != 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


class Grown:
    """The windows around hits: places, their distinct keys with second fingerprints, and who holds them first."""

    def __init__(self, words: Words, window: int, begins: np.ndarray) -> None:
        self.at = np.flatnonzero(begins)
        keys = rolled(words.hashes, window, WINDOW)[self.at]
        check = (rolled(words.hashes, window, SECOND)[self.at] >> np.uint64(32)).astype(np.uint32)
        member, self.place = told_apart(keys, check)
        self.keys, self.first = keys[member], np.empty(len(member), FIRST)
        self.owner = words.ids[words.doc[self.at]]
        lowest = np.full(len(member), exchange.LAST_ID)
        np.minimum.at(lowest, self.place, self.owner)
        self.first["id"], self.first["check"] = lowest, check[member]
        # places ascend, so of equal windows of one document all but the first in this order stand later in it
        row = words.doc[self.at]
        order = np.lexsort((row, self.place))
        self.again = np.zeros(len(order), bool)
        self.again[order[1:]] = (np.diff(self.place[order]) == 0) & (np.diff(row[order]) == 0)

    def repeated(self, answers: pa.Table) -> np.ndarray:
        """Places of windows that also start earlier."""
        if not len(self.at):
            return self.at
        elsewhere = exchange.found(answers, "?")
        return self.at[self.again | (self.owner > self.first["id"][self.place]) | elsewhere[self.place]]


def _earlier(values: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether another slice holds the window in a document before the slice's own first."""
    member, group = told_apart(place.astype(np.uint64), first["check"])
    lowest = np.full(len(member), exchange.LAST_ID)
    np.minimum.at(lowest, group, first["id"])
    return first["id"] > lowest[group]


SCHEMA = (
    StructType().add("doc_id", LongType()).add("n_words", LongType()).add("n_removed", LongType()).add("kept", BinaryType())
    .add("starts", ArrayType(LongType())).add("ends", ArrayType(LongType()))
)


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept, starts, ends for every row of ``docs`` (doc_id, text).

    A word goes if ``window`` words in a row that cover it also start earlier, in a document with a smaller
    doc_id or before in the same document, judged on the input. starts and ends number the words of the
    maximal removed runs; kept is the other words with one blank between them, as UTF-8 bytes.

    Words are split at ASCII white space and compared as they are; windows never cross documents. A null text
    has no words, and documents shorter than a window lose none. A null doc_id counts as the largest; rows
    that repeat a doc_id are not earlier than one another, and each loses its own repeats. Other columns
    are not read. Equality of windows is decided by 64 and 32 bits of two fingerprints.
    """
    corpus = exchange.Corpus.of_texts(docs)
    total = corpus.total

    def probes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, keys, place, block = blocks(Words(table), window, total)
        return keys, np.bincount(place, weights=block, minlength=len(keys)) > 0

    def hits(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        marks = around_hits(Words(table), window, total, answers)
        return pa.table({
            "slice": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([-1], pa.int32()),
            "found": pa.array([np.packbits(marks).tobytes()], pa.binary()),
        })

    def grown(table: pa.Table, known: pa.Table) -> tuple[Words, Grown, pa.Table]:
        words = Words(table)
        first = known["part"].to_numpy() < 0
        bits = b"".join(known.filter(pa.array(first))["found"].to_pylist())
        marks = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words.doc)).astype(bool)
        return words, Grown(words, window, marks), known.filter(pa.array(~first))

    def windows(table: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, own, _ = grown(table, known)
        return own.keys, own.first

    def cut(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        words, own, answers = grown(table, known)
        at = own.repeated(answers)
        gone = covered(at, at + window, len(words.doc))
        edge = np.flatnonzero(gone & ((words.place == 0) | ~np.concatenate([[False], gone[:-1]])))
        last = words.place == words.counts[words.doc] - 1
        stop = np.flatnonzero(gone & (last | ~np.concatenate([gone[1:], [False]])))
        n = len(words.ids)
        bounds, kept = joined(words.data, words.begins, words.ends, words.counts, ~gone)
        kept = kept.tobytes()
        per_doc = pa.array(np.concatenate([[0], np.cumsum(np.bincount(words.doc[edge], minlength=n))]).astype(np.int32))
        return pa.table({
            "doc_id": exchange.id_array(words.ids), "n_words": words.counts.astype(np.int64),
            "n_removed": np.bincount(words.doc[gone], minlength=n).astype(np.int64),
            "kept": pa.array([kept[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
            "starts": pa.ListArray.from_arrays(per_doc, pa.array(words.place[edge])),
            "ends": pa.ListArray.from_arrays(per_doc, pa.array(words.place[stop] + 1)),
        })

    by_slice = corpus.rows.groupBy("slice")
    answers = corpus.answer(corpus.ask(corpus.rows, probes), in_index, "?")
    marks = stored(by_slice.cogroup(answers.groupBy("slice")).applyInArrow(hits, exchange.ANSWER), "hits")
    last = corpus.answer(corpus.ask(corpus.rows, windows, marks), _earlier, FIRST)
    return by_slice.cogroup(marks.unionByName(last).groupBy("slice")).applyInArrow(cut, SCHEMA)
