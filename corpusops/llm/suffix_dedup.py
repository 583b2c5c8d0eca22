"""Removal of byte strings that an earlier document holds, by winnowed fingerprints in three rounds.

Digits are fingerprints of some bytes, dealt by their leading bits and grouped inside a part; no suffix is ordered.
Only what more than one document holds goes on to the next digit. The first digit is taken of few places: of every
window the one with the lowest fingerprint of DIGIT bytes, so equal windows agree on it. The second adds all the
bytes that any window around that place can hold: where an earlier document has them too, all these windows
repeat; where a digit has but one such surrounding, its first document holds no repeat there. The last one is
the window itself, for the places in between. Groups equal in it are the repeated windows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StructField, StructType

from corpusops.llm import exchange
from corpusops.session import stored

#: Bytes of the first digit at the usual threshold of 50, as a share of it.
DIGIT = 0.72
#: Bits of the first digit's fingerprint above those of the corpus's size in bytes; agreement by chance only costs time.
SPARE_BITS = 10
#: Bytes worked on at a time: what is formed of them stays in a core's cache.
CHUNK = 1 << 15
#: Bytes of text in a slice and behind the keys of a part, and those that a task packs at a time. Messages are slices times
#: parts, so these are as large as a worker's memory allows.
SLICE, PART, TOGETHER = 8 << 20, 12 << 20, 16 << 20

SYMBOL = exchange.mix(np.arange(1, 257, dtype=np.uint64))
FACTOR = int(exchange.mix(np.array([1062], np.uint64))[0]) | 1


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR to the powers 0 to n - 1, and its inverse to these."""
    out = np.empty((2, n), np.uint64)
    out[:], out[:, 0] = np.array([[FACTOR], [pow(FACTOR, -1, 1 << 64)]], np.uint64), 1
    return tuple(np.multiply.accumulate(out, axis=1))


def sums(data: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Of the symbols before each place, times falling powers. A difference of two, times the power of the last place
    in between, is the polynomial of what lies in between, wherever it stands."""
    symbols = np.take(SYMBOL, data, mode="clip")
    symbols *= down[: len(data)]
    out = np.zeros(len(data) + 1, np.uint64)
    np.add.accumulate(symbols, out=out[1:])
    return out


def _sliding(x: np.ndarray, width: int, lowest: bool) -> np.ndarray:
    """Lowest or highest of each ``width`` neighbours."""
    pick = np.minimum if lowest else np.maximum
    n, span, out = len(x) - width + 1, 1, x
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[:n], out[width - span : width - span + n])


class Windows:
    """The digits for windows of ``width`` bytes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.digit = max(1, round(width * DIGIT))
        self.spread = width - self.digit + 1  # places of the digit in a window

    def anchors(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and fingerprints of the digits that are the lowest of some window, in the texts of a slice."""
        n = max(len(data) - self.width + 1, 0)
        across = covered(np.maximum(offsets[:-1], offsets[1:] - self.width + 1), offsets[1:], len(data))  # starts of no window
        up, down = powers(CHUNK + 4 * self.width)
        edge = np.zeros(self.spread - 1, np.uint32)
        places, prints = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for a in range(0, n, CHUNK):
            low = max(0, a - self.spread + 1)
            end = a + CHUNK if a + CHUNK < n else len(data)
            total = sums(data[low : a + CHUNK + 2 * self.spread + self.digit], down)
            h = total[self.digit :] - total[: -self.digit]
            h *= up[self.digit - 1 : self.digit - 1 + len(h)]
            order = (h >> np.uint64(32)).astype(np.uint32)
            lowest = _sliding(order, self.spread, True)
            lowest *= ~across[low : low + len(lowest)]
            highest = _sliding(np.concatenate([edge, lowest, edge]), self.spread, False)
            at = np.flatnonzero(order == highest)
            at = at[(at >= a - low) & (at < end - low) & (highest[at] > 0)]
            places.append(at + low)
            prints.append(exchange.mix(h[at]))
        return np.concatenate(places), np.concatenate(prints)


def covered(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the ranges a to b - 1, of which no two overlap."""
    edges = np.zeros(n + 1, np.int8)
    np.add.at(edges, a, 1)
    np.add.at(edges, b, -1)
    return np.add.accumulate(edges, dtype=np.int8)[:n].view(bool)


def ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a[0] to b[0] - 1, then the next range."""
    size = b - a
    ends = np.cumsum(size)
    return np.repeat(a - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the ranges cover."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.empty(0, np.int64)
    return a[first], b[np.append(first[1:], len(a)) - 1] if len(a) else b


def fingerprints(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of data[a:b], for many short ranges, none of which starts before the one ahead of it."""
    out = np.empty(len(a), np.uint64)
    if not len(a):
        return out
    up, down = powers(CHUNK + (1 << int((b - a).max()).bit_length()))
    bounds = np.searchsorted(a, np.arange(0, len(data) + CHUNK, CHUNK))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        mine = slice(bounds[i], bounds[i + 1])
        low, high = a[mine] - i * CHUNK, b[mine] - i * CHUNK
        total = sums(data[i * CHUNK : i * CHUNK + high.max()], down)
        out[mine] = (total[high] - total[low]) * up[high - 1] + (high - low).astype(np.uint64) * up[high - low]
    return exchange.mix(out)


def _with_first(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each entry's place among them, and the smallest id that holds each."""
    values, place = exchange.ranked(keys)
    first = np.full(len(values), exchange.LAST_ID)
    np.minimum.at(first, place, ids)
    return values, place, first


def _second(values: np.ndarray, place: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """For a digit whether it has several surroundings, for surroundings whether an earlier document has them."""
    lowest, highest = np.full(len(values), exchange.LAST_ID), np.full(len(values), -1)
    np.minimum.at(lowest, place, extra)
    np.maximum.at(highest, place, extra)
    several = (lowest != highest) | (lowest < 0)
    return np.where(values[place] & np.uint64(1) == 0, several[place], extra > lowest[place])


class _Slice:
    """One slice in the rounds after the first digit; ``known`` are the answers so far, the places among them."""

    def __init__(self, table: pa.Table, known: pa.Table, windows: Windows) -> None:
        self.windows = windows
        self.ids, self.offsets, self.data = exchange.documents(table)
        rounds = known["round"].to_numpy()
        places = [np.frombuffer(b, "<i4") for b in known.filter(pa.array(rounds == 1))["found"].to_pylist()]
        at = np.sort(np.concatenate(places)).astype(np.int64) if places else np.empty(0, np.int64)
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        low, high = self.offsets[doc], self.offsets[doc + 1]
        self.a, self.b = np.maximum(at - windows.spread + 1, low), np.minimum(at + windows.width, high)
        self.at, self.owner, self.last = at, self.ids[doc], high - windows.width
        digit = fingerprints(self.data, at, at + windows.digit) & ~np.uint64(1)
        # where in its surroundings the digit stands is part of what must be equal
        around = exchange.mix(fingerprints(self.data, self.a, self.b) + (at - self.a).astype(np.uint64)) | np.uint64(1)
        keys, self.place, self.first = _with_first(np.concatenate([digit, around]), np.tile(self.owner, 2))
        self.keys, self.extra = keys, self.first.copy()
        of_digit, inside = np.split(self.place, 2)[0], (around >> np.uint64(24)).astype(np.int64)
        low, high = np.full(len(keys), exchange.LAST_ID), np.full(len(keys), -1)
        np.minimum.at(low, of_digit, inside)
        np.maximum.at(high, of_digit, inside)
        digits = keys & np.uint64(1) == 0
        self.extra[digits] = np.where(low == high, low, -1)[digits]
        self.rounds, self.known = rounds, known

    def _earlier(self, number: int, keys: np.ndarray, place: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.empty(0, bool)
        return exchange.found(self.known.filter(pa.array(self.rounds == number)), "?")[place] | (owner > first[place])

    def settle(self) -> None:
        """Uses the answers to the second digit: which surroundings an earlier document has, and which windows remain.

        They remain where a digit has several surroundings: in the first document of each of these.
        """
        if not len(self.at):
            several = self.whole = np.empty(0, bool)
        else:
            several = exchange.found(self.known.filter(pa.array(self.rounds == 2)), "?")[np.split(self.place, 2)[0]]
            self.whole = np.split(self._earlier(2, self.keys, self.place, self.first, np.tile(self.owner, 2)), 2)[1]
        still = several & ~self.whole
        self.starts = np.unique(ranges(self.a[still], np.minimum(self.at[still], self.last[still]) + 1))
        self.w_owner = self.ids[np.searchsorted(self.offsets, self.starts, side="right") - 1]
        prints = fingerprints(self.data, self.starts, self.starts + self.windows.width)
        self.w_keys, self.w_place, self.w_first = _with_first(prints, self.w_owner)

    def removed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first and last + 1 byte of the removed runs, in the slice's bytes."""
        starts = self.starts[self._earlier(3, self.w_keys, self.w_place, self.w_first, self.w_owner)]
        a = np.concatenate([self.a[self.whole], starts])
        b = np.concatenate([self.b[self.whole], starts + self.windows.width])
        doc = np.searchsorted(self.offsets, a, side="right") - 1
        a, b = merged(a + doc, b + doc)  # a gap after every document keeps runs apart
        gaps = self.offsets + np.arange(len(self.offsets))
        doc = np.searchsorted(gaps, a, side="right") - 1
        return doc, a - doc, b - doc


RESULT: dict[str, DataType] = {
    "doc_id": LongType(), "n_bytes": LongType(), "kept": BinaryType(), "starts": ArrayType(LongType()), "ends": ArrayType(LongType()),
}


def remove_repeats(docs: DataFrame, width: int = 50, carried: list[str] = ()) -> DataFrame:
    """The columns ``carried`` and doc_id, n_bytes, kept, starts, ends for every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes. A byte goes if a string of ``width`` bytes that covers it also starts in a document with
    a smaller doc_id, judged on the input; starts and ends are the maximal removed runs, kept is the rest.
    A carried column with the name of a result is left out.
    Strings never cross documents, and repeats inside one document stay. A null text counts as empty. A null
    doc_id counts as the largest; rows that repeat a doc_id are one document to each other.

    Two 64-bit fingerprints decide on equality. Every distinct key of a slice is sent once, with the smallest
    doc_id of the slice that holds it; the answer says whether another slice has a smaller one.
    """
    windows = Windows(width)
    carried = [c for c in carried if c not in RESULT]
    corpus = exchange.Corpus.of_texts(docs, carried, TOGETHER, slice_bytes=SLICE, part_bytes=PART)
    total = corpus.total
    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.select(*carried).schema.fields])
    for name, kind in RESULT.items():
        schema = schema.add(name, kind, True)

    def digits(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, offsets, data = exchange.documents(table)
        places, prints = windows.anchors(offsets, data)
        owner = np.repeat(ids, np.diff(np.searchsorted(places, offsets)))
        keys, place = exchange.ranked(exchange.leading(prints, total, SPARE_BITS))
        return places, owner, keys, place

    def first_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, owner, keys, place = digits(table)
        low, high = np.full(len(keys), exchange.LAST_ID), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, place, owner)
        np.maximum.at(high, place, owner)
        return keys, low < high

    def first_back(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        places, _, keys, place = digits(table)
        shared = exchange.found(answers, "?")[place] if len(keys) else np.empty(0, bool)
        return pa.table({
            "slice": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([0], pa.int32()),
            "found": pa.array([places[shared].astype("<i4").tobytes()], pa.binary()),
        })

    def second_keys(table: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = _Slice(table, known, windows)
        return own.keys, own.extra

    def last_keys(table: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = _Slice(table, known, windows)
        own.settle()
        return own.w_keys, own.w_first

    def cut(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        own = _Slice(table, known, windows)
        own.settle()
        doc, a, b = own.removed()
        n = len(own.ids)
        ends = np.cumsum(np.diff(own.offsets) - np.bincount(doc, b - a, n).astype(np.int64))
        left = [pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(own.data[~covered(a, b, len(own.data))])]
        kept = pa.Array.from_buffers(pa.binary(), n, [None, *left])
        bounds = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x - own.offsets[doc])) for x in (a, b)]
        results = pa.table({
            "doc_id": exchange.id_array(own.ids), "n_bytes": np.diff(own.offsets), "kept": kept,
            "starts": lists[0], "ends": lists[1],
        })
        if not carried:
            return results
        along = exchange.others(table)
        return pa.table([*along.columns, *results.columns], names=[*carried, *results.column_names])

    by_slice = corpus.rows.groupBy("slice")
    first = corpus.answer(corpus.ask(corpus.rows, first_keys), exchange.in_two, "?", exchange.ranked)
    places = stored(by_slice.cogroup(first.groupBy("slice")).applyInArrow(first_back, exchange.ANSWER), "places").withColumn("round", F.lit(1))
    second = corpus.answer(corpus.ask(corpus.rows, second_keys, places), _second, "<i8", exchange.ranked).withColumn("round", F.lit(2))
    known = places.unionByName(second)
    last = corpus.answer(corpus.ask(corpus.rows, last_keys, known), exchange.earlier, "<i8", exchange.ranked).withColumn("round", F.lit(3))
    return by_slice.cogroup(known.unionByName(last).groupBy("slice")).applyInArrow(cut, schema)
