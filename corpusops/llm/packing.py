"""Token pieces and their best-fit packing, certified by lower bounds."""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusops.llm.ragged import gather, slices, small_batches
from corpusops.session import stored

#: Pieces packed by one task, pieces that a task with a gap gives away, and tasks that pool them.
GROUP, RELEASED, POOL = 40_000, 4_096, 8
#: Distinct runs whose ids a Python worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000

_encoders: dict[str, "ChunkEncoder"] = {}


class Known:
    """Ids by run, in Arrow and numpy arrays: a run costs its bytes, its ids and 24 bytes."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.runs: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def make_room(self) -> None:
        if self.size > REMEMBERED:
            self.clear()

    def add(self, runs: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        self.runs.append(runs)
        self.lengths.append(lengths)
        self.ids.append(ids)
        self.size += len(runs)
        return np.arange(self.size - len(runs), self.size)

    def places(self, runs: pa.Array) -> np.ndarray:
        """The place of each run among the known ones, -1 for unknown ones."""
        if len(self.runs) != 1:
            self.runs = [pa.concat_arrays(self.runs) if self.runs else pa.array([], pa.large_string())]
        return pc.fill_null(pc.index_in(runs, value_set=self.runs[0]), -1).to_numpy().astype(np.int64)

    def rows(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of the runs at ``places`` and their ids, one run after the other."""
        if len(self.ids) > 1:
            self.lengths, self.ids = [np.concatenate(self.lengths)], [np.concatenate(self.ids)]
        starts = np.cumsum(self.lengths[0]) - self.lengths[0]
        lengths = self.lengths[0][places]
        return lengths, gather(self.ids[0], starts[places], lengths)


class ChunkEncoder:
    """Ids of whole texts for a tokenizer that drops white space and never joins across it.

    A text is cut into runs that the tokenizer keeps apart too: chunks between ASCII white space and, where a
    chunk is ASCII without apostrophe or ``<``, its runs of letters and of the rest. Each run carries the blanks
    behind it, which give no ids. Each distinct run is encoded once per worker. Many new words go to the
    library in one call, and the mark of the word end that each last token carries tells them apart again.
    """

    BLANK, LETTER, OTHER, WHOLE = range(4)
    KINDS = np.full(256, OTHER, np.uint8)
    KINDS[list(b" \t\n\v\f\r")] = BLANK
    KINDS[list(string.ascii_letters.encode())] = LETTER
    KINDS[list(b"'<") + list(range(128, 256))] = WHOLE

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.runs = Known()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: pa.Array) -> np.ndarray:
        """Adds the ids of ``runs``, none of which is known, and gives their places among the known ones."""
        places = np.empty(len(runs), np.int64)
        plain = pc.match_substring_regex(runs, "^[A-Za-z]+ $").to_numpy(zero_copy_only=False)
        words, rest = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        spelled = runs.take(pa.array(words)).to_pylist()
        groups = range(0, len(words), 500)
        for a, ids in zip(groups, self._library(["".join(spelled[a : a + 500]) for a in groups])):
            ids, own = np.array(ids, "<u4"), words[a : a + 500]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(own):
                places[own] = self.runs.add(runs.take(pa.array(own)), np.diff(stops, prepend=0), ids)
            else:  # a tokenizer without this property
                rest.append(own)
        rest = np.concatenate(rest)
        others = runs.take(pa.array(rest))
        found = self._library(others.to_pylist())
        places[rest] = self.runs.add(others, np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], "<u4"))
        return places

    def _cut(self, data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Where the runs begin; every text begins one."""
        kinds = self.KINDS[data]
        starts = np.zeros(len(data), bool)
        starts[1:] = (kinds[1:] != self.BLANK) & (kinds[:-1] == self.BLANK)  # chunks
        starts[text_starts] = True
        chunk_starts = np.flatnonzero(starts)
        whole = np.add.reduceat(kinds == self.WHOLE, chunk_starts, dtype=np.int64) > 0
        splits = np.zeros(len(data), bool)
        splits[1:] = (kinds[1:] != kinds[:-1]) & (kinds[1:] != self.BLANK)
        splits &= ~np.repeat(whole, np.diff(chunk_starts, append=len(data)))
        return np.flatnonzero(starts | splits)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text and the ids of all texts, one after the other."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # lower case makes no other difference
            texts = pc.ascii_lower(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(len(texts), np.int64), np.empty(0, "<u4")
        data[self.KINDS[data] == self.BLANK] = ord(" ")
        begins = self._cut(data, offsets[:-1][np.diff(offsets) > 0])
        bounds = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(begins), bounds, pa.py_buffer(data)).dictionary_encode()
        self.runs.make_room()
        places = self.runs.places(coded.dictionary)
        new = places < 0
        places[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        lengths, ids = self.runs.rows(places[coded.indices.to_numpy()])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return np.diff(upto[np.searchsorted(begins, offsets)]), ids


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32.

    A document is its ids followed by ``end_id``; a null or empty text is ``end_id`` alone. Only longer
    documents are cut. Of ``docs`` only doc_id and text are read; a null doc_id is carried through.
    """
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done, out = batch.column("doc_id").to_pylist(), 0, []
            for texts in slices(batch.column("text")):
                lengths, found = encoder(tokenizer).encode(texts)
                all_ids, ends = found.tobytes(), (4 * np.cumsum(lengths)).tolist()
                for doc, a, b in zip(ids[done : done + len(texts)], [0, *ends], ends):
                    own = all_ids[a:b] + end
                    for k, at in enumerate(range(0, len(own), width)):
                        piece = own[at : at + width]
                        out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                done += len(texts)
            columns = list(zip(*out)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, the best of the bounds that dual feasible functions give.

    Used: the identity, the rounding functions (x -> floor((k + 1) x / C) C / k, x itself where the
    quotient is whole) and the threshold functions (x below e -> 0, above C - e -> C), alone and composed.
    """
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.flatnonzero(counts)
    counts, x = counts[sizes], sizes.astype(np.int64)
    if not len(x):
        return 0
    best = -(-int(counts @ x) // capacity)
    half = x[x <= capacity // 2]
    thresholds = np.unique(half)[:: max(1, len(half) // 256)] if len(half) else np.array([], np.int64)
    for e in [0, *thresholds.tolist()]:
        f = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int(counts @ f) // capacity))
        for k in (1, 2, 3, 4, 5, 7, 9, 12):
            scaled = (k + 1) * f
            g = np.where(scaled % capacity == 0, k * f, scaled // capacity * capacity)  # times k
            best = max(best, -(-int(counts @ g) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: the longest first, each into the fullest bin that still takes it."""
    bins = np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0  # bit r of rooms: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[i] = b
        if room > size:
            with_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def _offsets(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.searchsorted(bins[order], bins[order])
    out = np.empty(len(bins), np.int64)
    out[order] = before - before[first]
    return out


def _pack_group(capacity: int, round_no: int, last: bool):
    """Packs one group. Bins that may still be improved on are given away: sequence_id stays null."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        lengths, old = table["length"].to_numpy(), table["old_bin"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        if round_no and len(np.unique(old)) <= len(np.unique(bins)):
            bins = np.unique(old, return_inverse=True)[1]  # the exchange found nothing better
        made = int(bins.max()) + 1
        released = np.zeros(len(bins), bool)
        if not last and made > lower_bound(lengths, capacity):
            fill = np.bincount(bins, weights=lengths, minlength=made)
            emptiest = np.argsort(fill, kind="stable")
            rows = np.cumsum(np.bincount(bins, minlength=made)[emptiest])
            gone = np.zeros(made, bool)
            gone[emptiest[(rows <= RELEASED) & (fill[emptiest] < capacity)]] = True
            released = gone[bins]
        ids = (round_no << 56) + (group << 24) + bins
        out = {c: table[c] for c in table.column_names if c not in ("group", "old_bin", "sequence_id", "offset")}
        out["old_bin"] = pa.array(ids)
        out["sequence_id"] = pa.array(ids, mask=released)
        out["offset"] = pa.array(_offsets(bins, lengths), mask=released)
        return pa.table(out)

    return run


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` in few bins.

    Groups of about GROUP pieces, dealt by hash, are packed by best-fit decreasing. A group whose number of
    bins equals its lower bound is certified and done. Any other gives its emptiest bins (at most
    RELEASED pieces) to an exchange in which POOL groups meet, and they are packed again, until one group
    is left; an exchange that saves nothing keeps the bins it was given. No task holds more than GROUP
    or POOL * RELEASED pieces. Every round is written to the shared folder.

    ``length`` (1 to ``capacity``) is the size of a piece; other columns are carried, but for input columns
    named like a result or ``group`` or ``old_bin``, which are replaced or left out. No pieces give no rows.
    """
    carried = [c for c in pieces.columns if c not in ("group", "old_bin", "sequence_id", "offset")]
    rows = stored(pieces.select(*carried), "pieces")
    groups = max(1, -(-rows.count() // GROUP))
    schema = StructType(list(rows.schema.fields))
    for name in ("old_bin", "sequence_id", "offset"):
        schema = schema.add(name, "long", nullable=True)
    done: list[DataFrame] = []
    left = rows.withColumn("group", F.pmod(F.xxhash64(*carried), F.lit(groups))).withColumn("old_bin", F.lit(0).cast("long"))
    round_no = 0
    while True:
        last = round_no > 0 and groups == 1
        packed = stored(left.groupBy("group").applyInArrow(_pack_group(capacity, round_no, last), schema), "packed")
        done.append(packed.where(F.col("sequence_id").isNotNull()))
        if last:
            break
        groups = -(-groups // POOL)
        round_no += 1
        left = packed.where(F.col("sequence_id").isNull()).withColumn("group", F.expr(f"((old_bin >> 24) & {(1 << 32) - 1}) div {POOL}"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.drop("old_bin")
