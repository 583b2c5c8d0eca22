"""Code lengths of texts under a context-tree weighting model of their bytes, and under word counts.

Each byte is eight binary decisions; the model keeps, for each context of 0 to DEPTH preceding bytes and each
place in a byte's binary tree, how often 0 and 1 followed in training. A node's Krichevsky-Trofimov estimate
is mixed half and half with what its longer contexts give, as block probabilities over the whole training
corpus, which gives the weight of every node. A text's probability is then the product of its decisions'.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.llm import exchange
from corpusops.llm.words import BLANK, LOWER, word_hashes, word_spans

#: Preceding bytes that a context holds at most.
DEPTH = 6
#: Bytes of text in a slice: larger ones repeat fewer strings.
SLICE = 5 << 20
#: Slices whose questions about one part of the contexts meet in one task.
SALT = 256
#: Stand before a text and end it; neither is a byte of UTF-8.
BEFORE, END = 0xFE, 0xFF
#: Preceding bytes that contexts are dealt by; nodes above are weighted by the driver (at most 255 * 256 ** (TOP - 1)).
TOP = 2
HALF = math.log(0.5)
#: Odd; the leading bits of a product with it depend on all bits of the other number.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Key of the end token among the words' fingerprints.
END_TOKEN = np.uint64(0xE0D0E0D0E0D0E0D1)

#: Which of some ids are of training texts.
Learn = Callable[[np.ndarray], np.ndarray]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series after a shift."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    inv = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260 - shift


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = n0.astype(np.float64), n1.astype(np.float64)
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1) - math.log(math.pi)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and each code's place among them.

    One sort of numbers that hold the leading bits of a code's product and its place; codes that share those bits
    are told apart by themselves.
    """
    if not len(codes):
        return codes, np.empty(0, np.int64)
    low = np.uint64((1 << len(codes).bit_length()) - 1)
    at = codes.view(np.uint64) * SPREAD
    at &= ~low
    at |= np.arange(len(codes), dtype=np.uint64)
    at.sort()
    at &= low
    at = at.view(np.int64)
    by_print = codes[at]
    new = np.ones(len(codes), bool)
    np.not_equal(by_print[1:], by_print[:-1], out=new[1:])
    values, group = by_print[new], np.cumsum(new, dtype=np.int32)
    del by_print, new
    order = np.argsort(values)
    values = values[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])  # a code stands twice where another shares its bits
    rank = np.empty(len(order) + 1, np.int64)
    rank[order + 1] = np.cumsum(first) - 1
    place = np.empty(len(codes), np.int64)
    place[at] = rank[group]
    return values[first], place


def grams(low: np.ndarray, begins: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of DEPTH + 1 bytes, one per byte of each text, and the number of them per text.

    A text is its words with one blank between them and END behind.
    """
    lengths = ends - begins
    first = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.concatenate([[0], np.cumsum(lengths + 1)])
    per_text = sizes[first[1:]] - sizes[first[:-1]] + (counts == 0)  # the last blank becomes END
    starts = np.cumsum(per_text + DEPTH) - per_text
    length = int((per_text + DEPTH).sum())
    out, inside, letter = np.full(length, BEFORE, np.uint8), np.ones(length, bool), np.ones(length, bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    blanks = starts[owner] + sizes[:-1] - sizes[first[owner]] + lengths
    inside[(starts[:, None] - 1 - np.arange(DEPTH)).ravel()] = False
    out[blanks] = 0x20
    out[starts + per_text - 1] = END
    letter &= inside
    letter[blanks] = letter[starts + per_text - 1] = False
    out[letter] = low[~BLANK[low]]  # what stands between blanks is words
    head, tail = np.zeros((2, max(length - DEPTH, 0)), np.uint32)  # a code's last four bytes and those before
    for k in range(DEPTH + 1):
        half = head if k < DEPTH - 3 else tail
        half <<= 8
        half |= out[k : k + len(half)]
    inside = inside[DEPTH:]
    return head[inside].astype(np.int64) << 32 | tail[inside], per_text


class _Slice:
    """Distinct tokens and strings of a slice, with their counts in its training texts."""

    def __init__(self, table: pa.Table, learn: Learn) -> None:
        self.ids, offsets, data = exchange.documents(table)
        self.low = LOWER[data]
        self.begins, self.ends, self.counts = word_spans(self.low, offsets)
        self.learn = learn(self.ids)

    def read_words(self) -> None:
        words = np.append(word_hashes(self.low, self.begins, self.ends), END_TOKEN)
        self.words, place = exchange.distinct(words)
        self.word, self.end = place[:-1], int(place[-1])
        self.word_train = self._trained(self.word, self.counts, len(self.words))
        self.word_train[self.end] += self.learn.sum()

    def read_grams(self) -> None:
        codes, self.sizes = grams(self.low, self.begins, self.ends, self.counts)
        self.grams, self.gram = distinct(codes)

    def count_grams(self) -> None:
        codes, sizes = grams(self.low, self.begins, self.ends, self.counts)
        codes <<= 1
        codes |= np.repeat(self.learn, sizes)
        codes.sort()
        trained = (codes & 1).astype(np.uint8)
        codes >>= 1
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        self.grams = codes[first]
        self.gram_train = np.add.reduceat(trained, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)

    def _trained(self, place: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(place[np.repeat(self.learn, sizes)], minlength=n).astype(np.int64)

    def parts(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The strings' parts, and the order that puts them by part."""
        part = (exchange.mix(_context(self.grams, TOP).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        return part, np.argsort(part, kind="stable")


def _per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def _context(code: np.ndarray, depth: int) -> np.ndarray:
    return (code >> 8) & ((1 << (8 * depth)) - 1)


def _bit_nodes(code: np.ndarray, depth: int):
    """For each of the eight decisions of a code's last byte: the node and the bit."""
    context, byte = _context(code, depth) << 8, code & 255
    for k in range(7, -1, -1):
        yield context | (256 | byte) >> (k + 1), (byte >> k) & 1


def _counted(code: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth with their numbers of zeros and ones."""
    nodes, bits = zip(*_bit_nodes(code, depth))
    values, place = distinct(np.concatenate(nodes))
    bits, counts = np.concatenate(bits), np.tile(count, 8)
    ones = np.bincount(place, weights=counts * bits, minlength=len(values))
    return values, np.bincount(place, weights=counts, minlength=len(values)) - ones, ones


def _parents(nodes: np.ndarray, depth: int) -> np.ndarray:
    """The node of the same decision with one byte of context less; ``depth`` is the parent's."""
    return (nodes >> 8 & ((1 << (8 * depth)) - 1)) << 8 | nodes & 255


def _weigh(code: np.ndarray, count: np.ndarray, least: int) -> tuple[dict[int, tuple], np.ndarray, np.ndarray]:
    """Nodes of depths DEPTH to ``least``: depth -> (nodes, chance of a one, weight of the own estimate); and
    the block probability below each node of depth ``least`` - 1, by node."""
    model, below = {}, None
    for depth in range(DEPTH, least - 1, -1):
        nodes, n0, n1 = _counted(code, count, depth)
        own = kt_block(n0, n1)
        if below is None:
            block = own
        else:
            block = np.logaddexp(HALF + own, HALF + below[1])  # same nodes: every node here has a child there
        weight = np.exp(own - block) * (0.5 if below is not None else 1.0)
        model[depth] = nodes, (n1 + 0.5) / (n0 + n1 + 1), weight
        up, place = exchange.distinct(_parents(nodes, depth - 1))
        below = up, np.bincount(place, weights=block, minlength=len(up))
    return model, *below


def _log10(code: np.ndarray, model: dict[int, tuple]) -> np.ndarray:
    """log10 of the probability of each code's last byte after the others."""
    out = np.zeros(len(code))
    chance = np.full((8, len(code)), 0.5)
    bits = np.array([(code >> k) & 1 for k in range(7, -1, -1)], bool)
    for depth in range(DEPTH, -1, -1):
        nodes, one, weight = model[depth]
        if not len(nodes):
            continue
        for k, (node, _) in enumerate(_bit_nodes(code, depth)):
            at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            there = nodes[at] == node
            mixed = weight[at] * one[at] + (1 - weight[at]) * chance[k]
            chance[k] = np.where(there, mixed, 0.5)
    for k in range(8):
        out += np.log10(np.where(bits[k], chance[k], 1 - chance[k]))
    return out


def _squeezed(codes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted codes as differences, and their counts, each compressed by planes of bytes."""
    return tuple(pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) for x in (np.diff(codes, prepend=0), counts))


def _entries(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The codes of each row, and all counts."""
    sizes = table["n"].to_pylist()
    codes, counts = (
        [np.frombuffer(pa.decompress(x, 8 * n, "zstd"), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel() for x, n in zip(table[c].to_pylist(), sizes)]
        for c in ("keys", "extra")
    )
    return [np.cumsum(c) for c in codes], np.concatenate(counts) if counts else np.empty(0, np.int64)


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, place = distinct(codes) if codes.dtype == np.int64 else exchange.distinct(codes)
    return values, np.bincount(place, weights=counts, minlength=len(values)).astype(np.int64)


def _top(nodes: np.ndarray, below: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> dict[int, tuple]:
    """The nodes above TOP, from the block probabilities below and the counts of those of depth TOP - 1."""
    model = {}
    for depth in range(TOP - 1, -1, -1):
        own = kt_block(n0, n1)
        block = np.logaddexp(HALF + own, HALF + below)
        order = np.argsort(nodes)
        model[depth] = nodes[order], ((n1 + 0.5) / (n0 + n1 + 1))[order], (0.5 * np.exp(own - block))[order]
        if depth:
            nodes, place = exchange.distinct(_parents(nodes, depth - 1))
            below, n0, n1 = (np.bincount(place, weights=x, minlength=len(nodes)) for x in (block, n0, n1))
    return model


def score(docs: DataFrame, learn: Learn) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Tokens are the words (A-Z in lower case) and one end per text. base_score is the sum over the tokens of
    log10((c + 1) / (N + V + 1)) with the token's count c in the training texts, whose ids ``learn`` tells, their
    tokens N and distinct tokens V. score is the log10 probability that the context-tree model learnt from the
    same texts gives to the words of the text, spelled in bytes with a blank between two and an end behind.

    A null text counts as empty: its only token is the end. Without training texts all counts are 0 and each
    binary decision has probability 1/2. Rows that repeat a doc_id and null ids (shown to ``learn`` as the largest
    number) are kept.

    A slice asks for its distinct words and its distinct strings of DEPTH + 1 bytes once. Words are counted by
    hashed parts; strings go to parts by their TOP last bytes of context. There the counts are added up in two
    steps, so no task reads more than SALT slices' strings or the distinct strings of one part, and the strings'
    counts of a part make its nodes and their weights. Nothing is broadcast but the nodes above TOP, at most 255 * 256 ** (TOP - 1) of them.
    """
    corpus = exchange.Corpus.of_texts(docs, slice_bytes=SLICE)
    parts, salts = min(256, 1 << corpus.bits), -(-corpus.slices // SALT)

    def word_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = _Slice(table, learn)
        own.read_words()
        return own.words, own.word_train

    def word_totals(table: pa.Table) -> pa.Table:
        keys = [exchange.unpack(k) for k in table["keys"].to_pylist()]
        counts = [exchange.from_bytes(e, "<i8", len(k)) for e, k in zip(table["extra"].to_pylist(), keys)]
        _, total = _merged(np.concatenate(keys), np.concatenate(counts))
        return pa.table({"tokens": pa.array([total.sum()], pa.int64()), "kinds": pa.array([(total > 0).sum()], pa.int64())})

    def gram_keys(key: tuple, table: pa.Table) -> pa.Table:
        own = _Slice(table, learn)
        own.count_grams()
        part, order = own.parts(parts)
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        cuts = [order[bounds[p] : bounds[p + 1]] for p in range(parts)]
        full = [p for p in range(parts) if len(cuts[p])]
        number = key[0].as_py()
        keys, extra = zip(*(_squeezed(own.grams[cuts[p]], own.gram_train[cuts[p]]) for p in full))
        return pa.table({
            "slice": pa.array([number] * len(full), pa.int64()),
            "part": pa.array(full, pa.int32()),
            "salt": pa.array([number % salts] * len(full), pa.int64()),
            "n": pa.array([len(cuts[p]) for p in full], pa.int32()),
            "keys": pa.array(keys, pa.binary()),
            "extra": pa.array(extra, pa.binary()),
        })

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _entries(table)
        codes, counts = _merged(np.concatenate(keys), counts)
        codes, counts = codes[counts > 0], counts[counts > 0]
        keys, extra = _squeezed(codes, counts)
        return pa.table({
            "part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(codes)], pa.int32()),
            "keys": pa.array([keys], pa.binary()), "extra": pa.array([extra], pa.binary()),
        })

    def top_nodes(table: pa.Table) -> pa.Table:
        keys, counts = _entries(table)
        codes = np.concatenate(keys)
        _, nodes, below = _weigh(codes, counts, TOP)
        _, n0, n1 = _counted(codes, counts, TOP - 1)
        return pa.table({"node": nodes, "below": below, "n0": n0, "n1": n1})

    def reply(key: tuple, table: pa.Table, models: pa.Table) -> pa.Table:
        keys, _ = _entries(table)
        known, counts = _entries(models)
        lists = models["top"].to_pylist()[0]
        top = [np.array([t[k] for t in lists], np.int64 if k == "node" else np.float64) for k in ("node", "below", "n0", "n1")]
        codes, place = exchange.distinct(np.concatenate(keys))
        model, _, _ = _weigh(np.concatenate(known), counts, TOP)
        values = _log10(codes, model | _top(*top)).astype("<f4")[place]
        answers = np.split(values, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({
            "slice": table["slice"], "part": table["part"],
            "found": pa.array([exchange.framed(x) for x in answers], pa.binary()),
        })

    def back(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        own = _Slice(table, learn)
        own.read_words()
        own.read_grams()
        rounds = known["round"].to_numpy()
        count = exchange.found(known.filter(pa.array(rounds == 1)), "<i8")
        _, order = own.parts(parts)
        log10 = np.empty(len(own.grams))
        log10[order] = exchange.found(known.filter(pa.array(rounds == 2)), "<f4")
        c = count[own.word]
        end = count[own.end]
        return pa.table({
            "doc_id": exchange.id_array(own.ids),
            "n_tokens": own.counts + 1,
            "n_known": _per_text((c > 0).astype(np.int64), own.counts) + int(end > 0),
            "sum": _per_text(np.log10(c + 1.0), own.counts) + math.log10(end + 1),
            "score": _per_text(log10[own.gram], own.sizes),
        })

    by_slice = corpus.rows.groupBy("slice")
    word_asks = corpus.ask(corpus.rows, word_keys)
    words = corpus.answer(word_asks, exchange.summed, "<i8").withColumn("round", F.lit(1))
    totals = word_asks.groupBy("part").applyInArrow(word_totals, "tokens long, kinds long").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")
    )
    asks = by_slice.applyInArrow(gram_keys, "slice long, part int, salt long, n int, keys binary, extra binary")
    counted = "part int, n int, keys binary, extra binary"
    sums = asks.groupBy("part", "salt").applyInArrow(add_up, counted).groupBy("part").applyInArrow(add_up, counted)
    top = (
        sums.groupBy("part").applyInArrow(top_nodes, "node long, below double, n0 double, n1 double")
        .groupBy("node").agg(*[F.sum(c).alias(c) for c in ("below", "n0", "n1")])
        .agg(F.collect_list(F.struct("node", "below", "n0", "n1")).alias("top"))  # of a fixed greatest size
    )
    models = sums.crossJoin(F.broadcast(top)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    strings = asks.groupBy("part", "salt").cogroup(models.groupBy("part", "salt")).applyInArrow(reply, exchange.ANSWER).withColumn("round", F.lit(2))
    scored = by_slice.cogroup(words.unionByName(strings).groupBy("slice")).applyInArrow(
        back, "doc_id long, n_tokens long, n_known long, sum double, score double"
    )
    return scored.crossJoin(F.broadcast(totals)).select(  # one row
        "doc_id", "n_tokens", "n_known", "train_tokens",
        (F.col("sum") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("kinds") + 1)).alias("base_score"), "score",
    )
