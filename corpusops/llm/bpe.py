"""Byte-level BPE by speculation: longest-match proposals, pair checks, exact merging for the rest."""

from __future__ import annotations

import json
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.llm.ragged import Memo, slices, small_batches

#: Distinct words whose ids a Python worker remembers; beyond that it starts anew.
REMEMBERED = 500_000
#: How this kind of tokenizer cuts a text into words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII, and controls that some rules count as such (fixed value).
ODD_BLANKS = "[\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]"
NEVER = np.iinfo(np.int64).max

_codecs: dict[str, "Codec"] = {}


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in the vocabulary of such a tokenizer."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder for one vocabulary file.

    Merges are learnt in order, so inside a word the time of a merge is its rank. Two neighbouring tokens are
    compatible when no merge across their border would have come first: for every token on the right edge of
    the left one's merge tree and every token on the left edge of the right one's, a merge of the two must not
    rank before the merges that consume them. A proposal whose tokens are sound and whose neighbours
    are all compatible is what exact merging gives.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.table = pa.array(self.bytes_of, pa.large_binary())
        self.single = {self.bytes_of[vocab[c]]: vocab[c] for c in symbols if c in vocab}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        self.size = size
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        ranks = np.array([r for r, _ in self.rank.values()], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], ranks[order]
        self.merge_made = np.array([c for _, c in self.rank.values()], np.int64)[order]
        self.first = np.full(256, -1, np.int64)
        for b, i in self.single.items():
            self.first[b[0]] = i
        self._edges()
        self.words = Memo(REMEMBERED, "<i4")
        self.pairs = np.empty(0, np.int64)  # checked pairs, sorted, and what was found
        self.pairs_ok = np.empty(0, bool)
        self.cut = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _edges(self) -> None:
        """Right and left edges of every token's merge tree with the rank of the merge that consumes each part."""
        left, right, made = (np.full(self.size, -1, np.int64) for _ in range(3))
        for (a, b), (r, c) in self.rank.items():
            if made[c] < 0:
                left[c], right[c], made[c] = a, b, r
        self.left_edge, self.right_edge = self._edge(left, made), self._edge(right, made)
        whole = np.flatnonzero(made >= 0)
        fine = np.ones(self.size, bool)
        fine[whole] = self._compatible(left[whole], right[whole], made[whole])
        for c in whole[np.argsort(made[whole])].tolist():
            fine[c] = fine[c] and fine[left[c]] and fine[right[c]]
        self.by_bytes = {self.bytes_of[i]: i for i in {*whole[fine[whole]].tolist(), *self.single.values()}}
        longest: dict[bytes, int] = {}
        for b in self.by_bytes:
            longest[b[:2]] = max(len(b), longest.get(b[:2], 1))
        self.longest = longest

    def _edge(self, part: np.ndarray, made: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        token, until = np.arange(self.size), np.full(self.size, NEVER)
        out = []
        while (token >= 0).any():
            out.append((token, until))
            there = token >= 0
            token, until = np.where(there, part[token], -1), np.where(there, made[token], -1)
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray, top: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of a and b comes before both sides are complete (by ``top``)."""
        ok = np.ones(len(a), bool)
        for token_a, until_a in self.right_edge:
            x, ux = token_a[a], until_a[a]
            if top is not None:
                ux = np.minimum(ux, top)
            for token_b, until_b in self.left_edge:
                y, uy = token_b[b], until_b[b]
                if top is not None:
                    uy = np.minimum(uy, top)
                rows = np.flatnonzero(ok & (x >= 0) & (y >= 0))
                if not len(rows):
                    continue
                rank, _ = self._merges(x[rows], y[rows])
                # of equal ranks the left one goes first
                first = (rank < ux[rows]) & (rank <= uy[rows] if top is None else rank < uy[rows]) & (rank < NEVER)
                ok[rows[first]] = False
        return ok

    def _pair_ok(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, inverse = np.unique(a.astype(np.int64) * self.size + b, return_inverse=True)
        at = np.searchsorted(self.pairs, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == keys[inside]
        ok = np.empty(len(keys), bool)
        ok[known] = self.pairs_ok[at[known]]
        new = keys[~known]
        ok[~known] = self._compatible(new // self.size, new % self.size)
        if len(self.pairs) < 4 * REMEMBERED:
            self.pairs = np.insert(self.pairs, at[~known], new)
            self.pairs_ok = np.insert(self.pairs_ok, at[~known], ok[~known])
        return ok[inverse]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, end = [], 0, len(word)
        by_bytes, longest = self.by_bytes, self.longest
        while at < end:
            stop = min(end, at + longest.get(word[at : at + 2], 1))
            while word[at:stop] not in by_bytes:
                stop -= 1
            out.append(by_bytes[word[at:stop]])
            at = stop
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words at once: in each round every word makes its lowest merge, the left of equals."""
        out: list[list[int]] = [[] for _ in words]
        lengths = np.array([len(w) for w in words], np.int64)
        tokens = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(tokens):
            rank, made = np.full(len(tokens), NEVER), np.full(len(tokens), -1)
            at = np.flatnonzero(owner[1:] == owner[:-1])
            rank[at], made[at] = self._merges(tokens[at], tokens[at + 1])
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(tokens))
            done = np.repeat(lowest == NEVER, sizes)
            ends = np.flatnonzero(np.diff(owner[done], prepend=-1))
            for w, ids in zip(owner[done][ends].tolist(), np.split(tokens[done], ends[1:])):
                out[w] = ids.tolist()
            hits = np.flatnonzero((rank == np.repeat(lowest, sizes)) & ~done)
            hits = hits[np.diff(owner[hits], prepend=-1) > 0]  # the left one in each word
            tokens[hits] = made[hits]
            keep = ~done
            keep[hits + 1] = False
            tokens, owner = tokens[keep], owner[keep]
        return out

    def _merges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging a and b; NEVER and -1 where there is no such merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        there = self.merge_keys[at] == key
        return np.where(there, self.merge_ranks[at], NEVER), np.where(there, self.merge_made[at], -1)

    def _word_ids(self, words: list[bytes]) -> list[list[int]]:
        proposals = [self.propose(w) for w in words]
        lengths = np.array([len(p) for p in proposals], np.int64)
        flat = np.array([i for p in proposals for i in p], np.int64)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), lengths)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            bad = np.unique(owner[inner[~self._pair_ok(flat[inner], flat[inner + 1])]]).tolist()
            for w, ids in zip(bad, self.merge([words[w] for w in bad])):
                proposals[w] = ids
        return proposals

    def _learn(self, pieces: list[str]) -> None:
        """Remembers the ids of new pieces; only those with an apostrophe or beyond ASCII can hold several words."""
        mixed = [p for p in pieces if not p.isascii() or "'" in p]
        words = [p for p in pieces if p.isascii() and "'" not in p]
        self._add(words, self._word_ids([w.encode() for w in words]))
        cut = [self.cut.findall(p) for p in mixed]
        parts = list(set().union(*cut))
        known = dict(zip(parts, self._word_ids([w.encode() for w in parts])))
        self._add(mixed, [[i for w in c for i in known[w]] for c in cut])

    def _add(self, pieces: list[str], ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.words.add(pieces, lengths, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())))

    BLANK, LETTER, DIGIT, OTHER, WHOLE = range(5)
    KINDS = np.full(256, OTHER, np.uint8)
    KINDS[list(b" \t\n\v\f\r")] = BLANK
    KINDS[list(string.ascii_letters.encode())] = LETTER
    KINDS[list(string.digits.encode())] = DIGIT
    KINDS[[ord("'"), *range(128, 256)]] = WHOLE

    def _cut_ascii(self, data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Where words begin; a chunk with an apostrophe or a character beyond ASCII stays one piece.

        A blank right before a word belongs to it. The last of several blanks before a word stands apart from
        those before it, and blanks at the end of a text stay together.
        """
        kinds = self.KINDS[data]
        blank = kinds == self.BLANK
        begins = np.zeros(len(data), bool)
        begins[text_starts] = True
        text_first = begins.copy()
        before_word = np.zeros(len(data), bool)
        before_word[:-1] = blank[:-1] & ~blank[1:] & ~text_first[1:]  # the last blank before a word
        joins = before_word & (data == ord(" "))
        begins |= before_word
        begins[1:] |= (blank[1:] & ~blank[:-1]) | (~blank[1:] & blank[:-1] & ~joins[:-1])
        chunk_starts = np.flatnonzero(begins)
        whole = np.add.reduceat(kinds == self.WHOLE, chunk_starts, dtype=np.int64) > 0
        splits = np.zeros(len(data), bool)
        splits[1:] = (kinds[1:] != kinds[:-1]) & ~blank[1:] & ~blank[:-1]
        splits &= ~np.repeat(whole, np.diff(chunk_starts, append=len(data)))
        return np.flatnonzero(begins | splits)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text and the ids of all, one after the other.

        Texts with a special token or with white space beyond ASCII are cut by the full pattern, all others by
        the kinds of their bytes.
        """
        self.words.make_room()
        slow = pc.match_substring_regex(texts, ODD_BLANKS).to_numpy(zero_copy_only=False)
        for s in self.special:
            slow = slow | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        by_hand = {int(i): self._by_hand(texts[int(i)].as_py()) for i in np.flatnonzero(slow)}
        plain = texts.filter(pa.array(~slow)) if by_hand else texts
        offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begins = self._cut_ascii(data, offsets[:-1][np.diff(offsets) > 0]) if len(data) else np.empty(0, np.int64)
        bounds = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(begins), bounds, pa.py_buffer(data)).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        odd = {w for found in by_hand.values() for w in found if isinstance(w, str)}.difference(pieces) if by_hand else set()
        self._learn(self.words.unknown([*pieces, *odd]))
        lengths, ids = self.words.rows(self.words.slots_of(pieces)[coded.indices.to_numpy()])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.zeros(len(texts), np.int64)
        counts[~slow] = np.diff(upto[np.searchsorted(begins, offsets)])
        if not by_hand:
            return counts, ids
        parts, at = [], 0
        for i, count in enumerate(counts.tolist()):
            if slow[i]:
                own = [self.words.rows(self.words.slots_of([w]))[1] if isinstance(w, str) else np.array([w], "<i4") for w in by_hand[i]]
                parts.append(np.concatenate(own) if own else ids[:0])
                counts[i] = len(parts[-1])
            else:
                parts.append(ids[at : at + count])
                at += count
        return counts, np.concatenate(parts)

    def _by_hand(self, text: str) -> list[str | int]:
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            out += [*self.cut.findall(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self.cut.findall(text[at:])

    def decode(self, lengths: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The text of each row of ids; bytes that are no UTF-8 become U+FFFD."""
        spelled = self.table.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(spelled.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        bounds = ends[np.concatenate([[0], np.cumsum(lengths)])]
        data = spelled.buffers()[2] if len(ids) else pa.py_buffer(b"")
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds.copy()), data])
        try:
            return joined.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.large_string())


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _lists(lengths: np.ndarray, ids: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int), decoded for every row of ``docs`` (doc_id, text; no other column is read).

    ids is what the tokenizer gives for the whole text without added special tokens (such a token's own
    string in a text is that token), decoded what it gives back for these ids. A null text counts as empty;
    an empty text has no ids. Repeated rows are kept, a null doc_id is carried through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text")):
                lengths, ids = codec(tokenizer).encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, len(texts)), _lists(lengths, ids), codec(tokenizer).decode(lengths, ids).cast(pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )
                done += len(texts)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text for rows of doc_id, ids (array of int); null or empty ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            text = codec(tokenizer).decode(lengths, column.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.cast(pa.string())], names=["doc_id", "text"])

    return small_batches(rows).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
