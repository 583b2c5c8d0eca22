"""Jaccard join of documents on word shingles, with token-combination prefixes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.llm import exchange
from corpusops.llm.components import components, forest
from corpusops.llm.words import shingle_sets
from corpusops.session import stored

#: A shingle in more sets than this is frequent and is indexed in pairs only.
FREQUENT = 64
#: Frequent shingles of a prefix that one of its groups holds on average; pairs are made inside a group.
GROUP = 8
#: Sets compared in one task, and numbers in a dense block of that comparison.
TILE, DENSE = 4096, 1 << 22


#: Bits of a shingle's fingerprint, above those of the corpus's size in bytes, that tell whether another document
#: has it. Two that agree in them by chance only make a document a candidate; sets are compared in full.
SPARE_BITS = 10


def _least(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with any set it links with."""
    return -(-n * percent // 100)


def _signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, digest, shared: per document its number of shingles and, for those that can link at all, a
    digest of the whole set and the shingles that occur in another document too.

    A shingle of one document alone is in no intersection. So a document can link only if enough of its
    shingles are in other documents; for all others digest and shared are null.
    """
    corpus = exchange.Corpus.of_texts(docs)
    total = corpus.total

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = exchange.documents(table)
        sets, _ = shingle_sets(data, offsets, size)
        keys, place = exchange.distinct(exchange.leading(sets, total, SPARE_BITS))
        return keys, np.bincount(place, minlength=len(keys)) > 1

    def back(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, offsets, data = exchange.documents(table)
        sets, bounds = shingle_sets(data, offsets, size)
        _, place = exchange.distinct(exchange.leading(sets, total, SPARE_BITS))
        shared = exchange.found(answers, "?")[place] if len(sets) else np.empty(0, bool)
        n = np.diff(bounds)
        upto = np.concatenate([[0], np.cumsum(shared)])
        able = (n > 0) & (upto[bounds[1:]] - upto[bounds[:-1]] >= _least(n, percent))
        digests: list[bytes | None] = [None] * len(ids)
        kept: list[bytes | None] = [None] * len(ids)
        for d in np.flatnonzero(able).tolist():
            own = sets[bounds[d] : bounds[d + 1]]
            digests[d] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            kept[d] = own[shared[bounds[d] : bounds[d + 1]]].tobytes()
        return pa.table({
            "doc_id": exchange.id_array(ids), "n": n.astype(np.int64),
            "digest": pa.array(digests, pa.binary()), "shared": pa.array(kept, pa.binary()),
        })

    answers = corpus.answer(corpus.ask(corpus.rows, keys_of), exchange.in_two, "?")
    return corpus.rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        back, "doc_id long, n long, digest binary, shared binary"
    )


def _level(n: int, percent: int) -> int:
    """Linked sets are at most one level apart."""
    return math.floor(math.log(n) / math.log(100 / percent) + 1e-9)


def _groups(level: int, percent: int) -> int:
    longest = (100 / percent) ** (level + 1)
    return max(1, math.ceil(longest * (100 - percent) / 100 / GROUP))


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """u, v: a star for every key that two sets or more share."""
    corpus = exchange.Corpus(classes, "rep", "shared")

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        blobs = table["shared"].to_pylist()
        keys, place = exchange.distinct(np.frombuffer(b"".join(blobs), np.uint64))
        return keys, np.minimum(np.bincount(place, minlength=len(keys)), 65535).astype("<u2")

    def sets_with(values: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.minimum(exchange.summed(values, place, count), 65535).astype("<u2")

    def index(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        blobs = table["shared"].to_pylist()
        sets = np.frombuffer(b"".join(blobs), np.uint64)
        _, place = exchange.distinct(sets)
        often = exchange.found(answers, "<u2")[place] if len(sets) else np.empty(0, "<u2")
        keys, reps, at = [], [], 0
        for rep, n, blob in zip(table["rep"].to_pylist(), table["n"].to_pylist(), blobs):
            own, sets_of = sets[at : at + len(blob) // 8], often[at : at + len(blob) // 8]
            at += len(own)
            order = np.lexsort((own, sets_of))
            found = _keys(own[order], sets_of[order] > FREQUENT, n, percent)
            keys.append(found)
            reps.append(np.full(len(found), rep, np.int64))
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        return pa.table({"key": flat.view(np.int64), "rep": np.concatenate(reps) if reps else np.empty(0, np.int64)})

    answers = corpus.answer(corpus.ask(corpus.rows, keys_of), sets_with, "<u2")
    keys = stored(corpus.rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(index, "key long, rep long"), "keys")
    centres = keys.groupBy("key").agg(F.min("rep").alias("v"), F.max("rep").alias("high")).where("v < high").select("key", "v")
    return keys.join(centres, "key").select(F.col("rep").alias("u"), "v").where("u <> v").distinct()


def _keys(ordered: np.ndarray, frequent: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Index keys of one set of n shingles; ``ordered`` are its shared ones, rare before frequent."""
    usual = n - _least(n, percent) + 1 - (n - len(ordered))  # unshared ones come first of all
    level = _level(n, percent)
    out = []
    for at in (level, level + 1):
        groups = _groups(at, percent)
        prefix, often = ordered[: usual + groups], frequent[: usual + groups]
        out.append(exchange.mix(prefix[~often] + np.uint64(at)))
        prefix = prefix[often]
        group = exchange.mix(prefix) % np.uint64(groups)
        for g in np.unique(group):
            x = np.sort(prefix[group == g])
            i, j = np.triu_indices(len(x), 1)
            out.append(exchange.mix(exchange.mix(x[i] + np.uint64(at)) ^ x[j]))
    return np.concatenate(out)


def linked(x: np.ndarray, y: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (x + y - shared)


class _Sets:
    def __init__(self, sets: list[np.ndarray]) -> None:
        self.flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])

    def matrix(self, a: int, b: int, column: np.ndarray, width: int) -> np.ndarray:
        """0/1 rows a to b over the tokens that have a column (others: -1)."""
        part = column[self.flat[self.bounds[a] : self.bounds[b]]]
        rows = np.repeat(np.arange(b - a), np.diff(self.bounds[a : b + 1]))
        out = np.zeros((b - a, width), np.float32)
        out[rows[part >= 0], part[part >= 0]] = 1
        return out


def compare(reps: np.ndarray, n: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, root) of all pairs of a left and a right set that reach the similarity.

    Sets stand in the order of their sizes, so a block of left ones meets only right ones of fitting size.
    Only shingles that two of the sets hold are looked at, and a set with too few of those is left out.
    Blocks are counted by matrix products of bounded size.
    """
    order = np.argsort(n, kind="stable")
    reps, n, left, right = reps[order], n[order], left[order], right[order]
    sets = [sets[i] for i in order.tolist()]
    while True:
        _, place = exchange.distinct(np.concatenate(sets) if sets else np.empty(0, np.uint64))
        often = (np.bincount(place) > 1)[place] if len(place) else np.empty(0, bool)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(often)])
        able = upto[bounds[1:]] - upto[bounds[:-1]] >= _least(n, percent)
        if able.all():
            break
        reps, n, left, right = reps[able], n[able], left[able], right[able]
        sets = [s for s, ok in zip(sets, able.tolist()) if ok]
    if not len(reps):
        return reps, reps
    local = _Sets([place[bounds[i] : bounds[i + 1]] for i in range(len(reps))])
    vocabulary = int(place.max()) + 1
    l_rows, r_rows = np.flatnonzero(left), np.flatnonzero(right)
    found_l, found_r = [], []
    at, step = 0, 256
    while at < len(l_rows):
        rows = l_rows[at : at + step]
        a, b = np.searchsorted(n[r_rows], [_least(int(n[rows[0]]), percent), int(n[rows[-1]]) * 100 // percent + 1])
        others = r_rows[a:b]
        tokens = np.unique(np.concatenate([local.flat[local.bounds[i] : local.bounds[i + 1]] for i in rows.tolist()]))
        if len(tokens) * max(len(others), len(rows)) > DENSE and step > 1:
            step //= 2
            continue
        column = np.full(vocabulary, -1, np.int64)
        column[tokens] = np.arange(len(tokens))
        mine = np.concatenate([local.matrix(i, i + 1, column, len(tokens)) for i in rows.tolist()])
        piece = max(1, DENSE // max(len(tokens), 1))
        for c in range(0, len(others), piece):
            part = others[c : c + piece]
            theirs = np.concatenate([local.matrix(i, i + 1, column, len(tokens)) for i in part.tolist()])
            shared = (mine @ theirs.T).astype(np.int64)
            i, j = np.nonzero(linked(n[rows][:, None], n[part][None, :], shared, percent))
            found_l.append(rows[i])
            found_r.append(part[j])
        at += len(rows)
        step = min(256, step * 2)
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_l, found_r))
    root = forest(len(reps), i[i != j], j[i != j])
    hung = np.flatnonzero(root != np.arange(len(reps)))
    return reps[hung], reps[root[hung]]


def _tile(percent: int):
    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table["shared"].to_pylist()]
        reps, n = table["rep"].to_numpy(), table["n"].to_numpy()
        u, v = compare(reps, n, sets, side != 2, side != 1, percent)
        return pa.table({"u": u, "v": v})

    return run


def _with_pivot(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for n, blob, p_n, p_blob in zip(*(batch.column(c).to_pylist() for c in ("n", "shared", "p_n", "p_shared"))):
                common = len(np.intersect1d(np.frombuffer(blob, np.uint64), np.frombuffer(p_blob, np.uint64), assume_unique=True))
                hits.append(bool(linked(n, p_n, common, percent)))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("p_rep"), pa.array(hits, pa.bool_())], names=["u", "v", "hit"])

    return run


def _verified(classes: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """u, v: links that hold, enough of them to connect all that are connected.

    Sets that hang together by shared keys form a cluster. In a cluster above TILE sets, all are first compared
    with the one that has the smallest share of shingles of its own; only sets that do not link with it are
    left to be compared with every other, in tiles of two blocks. A smaller cluster is one tile.
    """
    clusters = components(candidates)
    members = stored(classes.join(clusters.withColumnRenamed("node", "rep"), "rep"), "members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("sets"))
    large = sizes.where(F.col("sets") > TILE).select("root")
    alone = 1 - F.octet_length("shared") / 8 / F.col("n")
    inside = members.join(large, "root")
    pivots = inside.groupBy("root").agg(F.min_by(F.struct("rep", "n", "shared"), F.struct(alone, "rep")).alias("p")).select(
        "root", F.col("p.rep").alias("p_rep"), F.col("p.n").alias("p_n"), F.col("p.shared").alias("p_shared")
    )
    against = stored(inside.join(pivots, "root").mapInArrow(_with_pivot(percent), "u long, v long, hit boolean"), "pivots")
    settled = against.where("hit").select(F.col("u").alias("rep"), F.lit(True).alias("settled"))
    left = members.join(sizes, "root").join(settled, "rep", "left").withColumn("open", F.col("settled").isNull())
    opens = left.where((F.col("sets") > TILE) & F.col("open")).groupBy("root").agg(F.count(F.lit(1)).alias("open_sets"))
    placed = left.join(opens, "root", "left").where((F.col("sets") <= TILE) | F.col("open_sets").isNotNull()).select(
        "root", "rep", "n", "shared", "open", (F.col("sets") <= TILE).alias("small"),
        F.when(F.col("sets") <= TILE, 1).otherwise(F.ceil(F.col("open_sets") / (TILE // 2))).cast("long").alias("nl"),
        F.when(F.col("sets") <= TILE, 1).otherwise(F.ceil(F.col("sets") / (TILE // 2))).cast("long").alias("nr"),
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = ["root", "rep", "n", "shared"]
    own = F.xxhash64("rep")
    tiles = (
        placed.where("small").select(*rest, F.lit(0).cast("long").alias("lb"), F.lit(0).cast("long").alias("rb"), F.lit(0).alias("side"))
        .unionByName(placed.where("not small and open").select(*rest, F.pmod(own, F.col("nl")).alias("lb"), upto("nr").alias("rb"), F.lit(1).alias("side")))
        .unionByName(placed.where("not small").select(*rest, upto("nl").alias("lb"), F.pmod(own, F.col("nr")).alias("rb"), F.lit(2).alias("side")))
    )
    links = tiles.groupBy("root", "lb", "rb").applyInArrow(_tile(percent), "u long, v long")
    return links.unionByName(against.where("hit").select("u", "v"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text; no other column is read).

    A document's set is its distinct ``size``-word shingles; two documents link when
    100 * intersection >= ``percent`` * union. component_id is the smallest doc_id reachable by links. All
    links count, but only enough of them are made to connect what is connected: equal sets are one
    class from the start, and inside a task links shrink to a spanning forest.

    Candidates: shingles are ordered by the number of sets that hold them, the rare first. By overlap, two linked
    sets share at least g + 1 shingles of prefixes that are g longer than usual. A rare shingle of a prefix is a
    key by itself. Frequent ones are dealt into g groups and every pair inside a group is a key: of g + 1
    shared ones two are in one group. Keys are kept apart by level of size, and linked sets are at most one
    level apart. Sets with a common key are verified exactly.

    A null or wordless text has the empty set and links with nothing, itself as component. A null doc_id
    stands for no document that others can reach: its component is null. Rows that repeat a doc_id are one node.
    """
    found = stored(_signatures(docs, size, percent), "shingles")
    able = found.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(able.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("shared").alias("shared")), "classes")
    sets = classes.select("rep", "n", "shared")
    links = stored(_verified(sets, _candidates(sets, percent), percent), "links")
    # rows that repeat a doc_id join the classes of their texts
    twice = able.join(classes.select("digest", F.col("rep").alias("v")), "digest").select(F.col("doc_id").alias("u"), "v").where("u <> v")
    reached = components(links.unionByName(twice))
    return found.select("doc_id", F.col("n").alias("n_shingles")).join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
    )
