"""Periodic runs of words inside documents, by uniting suffix classes from the longest common prefix down.

The suffixes of a document are ordered by prefix doubling, and neighbours in that order are edges that weigh as
much as their common prefix is long. Edges are taken as Kruskal would, the heaviest first; each class of a
union-find keeps its places in order. Where two classes meet, a place of the one and its new neighbour of the
other share a prefix of exactly the edge's weight; if they are no farther apart than that, the stretch between
them repeats, and they seed a run with their distance as its period. A smaller period would have put a
place between them before, so the period is the smallest, and a seed that cannot be moved to the left is a whole run.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from corpusops.llm.ragged import result_schema, slices, with_results, with_text
from corpusops.llm.words import BLANK, joined, word_spans

#: Bytes of text worked on at a time; a longer text is worked on alone.
SLICE = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_numbers(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    letters = np.ascontiguousarray(data[~BLANK[data]])
    bounds = np.concatenate([[0], np.cumsum(ends - begins)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def doubled_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, up to the depth at which all differ.

    A rank is the first place of the suffix's class in suffix order, so classes that are split keep the
    others' ranks, and only suffixes in classes of two and more are sorted again.
    """
    n = len(symbols)
    rank, left, key, depth = np.zeros(n, np.int64), np.arange(n), symbols, 0
    levels: list[np.ndarray] = []
    while len(left):
        order = np.argsort(key, kind="stable")
        sorted_key, old = key[order], rank[left[order]]
        t = np.arange(len(order))
        class_start = np.concatenate([[True], old[1:] != old[:-1]])
        place = old + t - np.maximum.accumulate(np.where(class_start, t, 0))
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        rank = rank.copy()
        rank[left[order]] = np.maximum.accumulate(np.where(new, place, 0))
        levels.append(rank.astype(np.int32) if n < 1 << 31 else rank)
        depth = 2 * depth if depth else 1
        left = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        key = rank[left] * n + rank[left + depth]
    return levels


def common_prefixes(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, and the places in that order whose common prefix with the one before is ``least`` or longer, with it."""
    suffixes = np.empty(len(levels[-1]), np.int64)
    suffixes[levels[-1]] = np.arange(len(suffixes))
    at = least.bit_length() - 1
    if at >= len(levels):
        return suffixes, np.empty(0, np.int64), np.empty(0, np.int64)
    ranks = levels[at][suffixes]
    place = np.flatnonzero(ranks[1:] == ranks[:-1]) + 1
    a, b, prefix = suffixes[place - 1], suffixes[place], np.zeros(len(place), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        prefix += (levels[k][a + prefix] == levels[k][b + prefix]).astype(np.int64) << k
    return suffixes, place[prefix >= least], prefix[prefix >= least]


def seeds(suffixes: np.ndarray, place: np.ndarray, prefix: np.ndarray, exponent: int) -> list[tuple[int, int, int]]:
    """First place, distance and common prefix of places that become neighbours in a class, if the prefix is
    ``exponent - 1`` times the distance or longer."""
    involved = np.unique(np.concatenate([place - 1, place]))
    members = [[p] for p in suffixes[involved].tolist()]
    root = list(range(len(members)))
    order = np.argsort(-prefix, kind="stable")
    lower = np.searchsorted(involved, place[order] - 1)  # its neighbour in suffix order comes next
    found = []
    times = exponent - 1
    for c, common in zip(lower.tolist(), prefix[order].tolist()):
        a, b = c, c + 1
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        before, at = -1, 0
        for i, x in enumerate(small):
            at = bisect_left(large, x, at)
            if at and large[at - 1] > before and times * (x - large[at - 1]) <= common:
                found.append((large[at - 1], x - large[at - 1], common))
            if at < len(large):
                right = large[at]
                if times * (right - x) <= common and (i + 1 == len(small) or small[i + 1] > right):
                    found.append((x, right - x, common))
            before = x
        if len(small) == 1:
            insort(large, small[0])
        else:
            large.extend(small)
            large.sort()  # two ordered parts, merged in one pass
        root[b], members[b] = a, None
    return found


def runs_of(numbers: np.ndarray, counts: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and period of all runs, ordered by first word and period; ``numbers`` are the words of all texts.

    Every text ends with a symbol of its own, and equal words of different texts are different symbols.
    """
    n, texts = len(numbers), len(counts)
    owner = np.repeat(np.arange(texts), counts)
    symbols = np.empty(n + texts, np.int64)
    kinds = int(numbers.max()) + 1 if n else 1
    symbols[np.arange(n) + owner] = owner * kinds + numbers
    symbols[np.cumsum(counts) + np.arange(texts)] = texts * kinds + np.arange(texts)
    levels = doubled_ranks(symbols)
    least = min_length - min_length // exponent  # what the first and the second period of a run share
    found = seeds(*common_prefixes(levels, max(least, 1)), exponent) if levels else []
    start, period, common = np.array(found, np.int64).reshape(-1, 3).T
    length = common + period
    stuck = (start == 0) | (levels[0][start - 1] != levels[0][start + period - 1]) if len(start) else np.empty(0, bool)
    keep = stuck & (length >= min_length) & (length >= exponent * period)
    rows = np.unique(np.stack([start, period, length], axis=1)[keep], axis=0)
    text = np.searchsorted(np.cumsum(counts + 1), rows[:, 0], side="right")
    return rows[:, 0] - text, rows[:, 2], rows[:, 1]  # without the ends of the texts before


def strongest(runs: list[tuple[int, int, int]]) -> int:
    """Which of some runs (start, length, period) has the most periods; ties go to the first start, then period."""
    return max(range(len(runs)), key=lambda i: (Fraction(runs[i][1], runs[i][2]), -runs[i][0], -runs[i][2]))


def _found(texts: pa.Array, min_length: int, exponent: int) -> tuple[pa.Array, ...]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    begins, ends, counts = word_spans(data, offsets - offsets[0])
    start, length, period = runs_of(word_numbers(data, begins, ends), counts, min_length, exponent)
    gone = np.zeros(len(begins) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    bounds, kept = joined(data, begins, ends, counts, np.cumsum(gone[:-1]) == 0)
    kept = kept.tobytes()
    first = np.cumsum(counts) - counts
    cuts = np.searchsorted(start, np.append(first, len(begins)))
    inside = start - first[np.repeat(np.arange(len(counts)), np.diff(cuts))]
    rows = list(zip(inside.tolist(), length.tolist(), period.tolist()))
    best = [rows[a + strongest(rows[a:b])] if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return (
        pa.array(counts.astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in (inside, length, period)], fields=list(RUN))),
        pa.array([None if r is None else dict(zip(("start", "length", "period"), r)) for r in best], RUN),
        pa.array([kept[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
    )


def find_runs(docs: DataFrame, min_length: int = 24, exponent: int = 3, carried: list[str] = ()) -> DataFrame:
    """doc_id, the columns ``carried``, n_words, runs, strongest and collapsed for every row of ``docs`` (doc_id, text).

    A run is a stretch of words in which words ``period`` apart are identical, period the smallest such, that is
    ``min_length`` words and ``exponent`` (2 or more) periods long or longer and that no neighbouring word extends.
    ``runs`` lists them by start and period; ``strongest`` has the greatest length to period, ties the
    smallest start, then period; ``collapsed`` holds the words that no run has behind its first period, with one
    blank between them, as UTF-8 bytes.

    Words are split at ASCII white space and compared as they are. Null and empty texts have no words and no
    runs. Repeated rows and null ids are kept; a carried column named like a result is left out. A
    document is worked on whole, in memory that grows with its words times the logarithm of its longest repeat.
    """
    results = ("n_words", "runs", "strongest", "collapsed")
    rows, wanted = with_text(docs, carried, results)
    kind = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
    schema = result_schema(rows.select(*wanted), n_words="long", runs=ArrayType(kind), strongest=kind, collapsed="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [_found(t, min_length, exponent) for t in slices(batch.column(0), SLICE)]
            yield with_results(batch, schema.names, *[pa.concat_arrays(list(c)) for c in zip(*found)])

    return rows.mapInArrow(run, schema)


def repeated_tail(words: Column, begin: Column, period: Column) -> Column:
    """``words`` with every one from ``begin`` on replaced by the word a multiple of ``period`` before it, from ``begin`` on."""
    places = F.sequence(F.lit(0), F.size(words) - 1)
    return F.transform(places, lambda i: F.get(words, F.when(i < begin, i).otherwise(begin + F.pmod(i - begin, period)).cast("int")))
