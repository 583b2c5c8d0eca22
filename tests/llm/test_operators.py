"""Every operator against a plain version, on the given tables and on rows with all the odd cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusops.llm import bpe, embed_dedup, exchange, langid, lm_scoring, ngram_join, packing, quality, sharding, suffix_dedup, topk
from corpusops.llm.components import components
from corpusops.llm.queries import QUERIES, fold
from corpusops.llm.ragged import slices

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slice long, score double"
PASSAGE = "a passage of more than fifty bytes that several of the documents share, word by word"
ODD = [
    (1, "Hello there, this is the first document. " + PASSAGE, "en", "a", 5, 7, 0.5),
    (2, None, "en", "a", None, None, None),
    (3, "", None, None, 0, 1, 1.0),
    (4, PASSAGE + " and an ending of its own", "en", "b", 1, 2, None),
    (5, "same text here for two rows " * 4, "fr", "b", 1, 2, 0.1),
    (6, "same text here for two rows " * 4, "fr", "b", 1, 2, 0.1),
    (6, "same text here for two rows " * 4, "fr", "b", 1, 2, 0.1),
    (7, " \n\t ", "en", None, 1, 2, 0.1),
    (None, PASSAGE, None, None, 1, 2, 0.1),
    (8, "one two", "de", "b", 1, 2, 0.1),
    (9, "ONE two", "de", "b", 1, 2, 0.1),
    (10, "été à la plage ça va 'll don't <|endoftext|> 　x  y\r\n!!" + PASSAGE[:60], "fr", "c", 1, 2, 0.1),
    (11, "long " * 30000 + "x" * 5000, "en", "c", 1, 2, 0.1),
    (12, "12345 !!! ???", "en", "c", 1, 2, 0.1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("source", ["odd", "docs"])
def test_suffix_dedup(source, request):
    df = request.getfixturevalue(source)
    rows = [(d, t.encode()) for d, t in texts_of(df)]
    high = 1 << 62
    first = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], high), high if d is None else d)
    want = Counter()
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (high if d is None else d):
                gone[i : i + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(b), runs, bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    got = Counter((r.doc_id, r.n_bytes, len(r.starts), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, 50).collect())
    assert got == want


def test_suffix_dedup_carries_columns(odd, none):
    got = suffix_dedup.remove_repeats(odd, 50, ["slice", "score", "lang"]).collect()
    assert Counter((r.doc_id, r.slice, r.score, r.lang) for r in got) == Counter((r[0], r[5], r[6], r[2]) for r in ODD)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_digits_of_a_whole_slice(monkeypatch):
    """Every window has one, equal windows the same ones, none reaches into the next text, and the cut into chunks changes nothing."""
    rng = np.random.default_rng(8)
    windows = suffix_dedup.Windows(50)
    texts = [bytes(rng.integers(97, 97 + int(rng.integers(1, 26)), int(n)).astype(np.uint8)) for n in rng.integers(0, 300, 40)]
    texts += [texts[3][:20] + texts[5] + texts[7], b"", b"x" * 49, b"y" * 400, texts[5]]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = windows.anchors(offsets, data)
    a = np.sort(rng.integers(0, len(data) - 64, 500))
    b = a + rng.integers(50, 64, 500)
    prints = suffix_dedup.fingerprints(data, a, b)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    assert all(np.array_equal(x, y) for x, y in zip(whole, windows.anchors(offsets, data)))
    assert np.array_equal(prints, suffix_dedup.fingerprints(data, a, b))
    of = {}
    assert all(of.setdefault(bytes(data[x:y]), p) == p for x, y, p in zip(a, b, prints.tolist())) and len(set(prints.tolist())) == len(of)
    seen = {}
    for low, high in zip(offsets[:-1], offsets[1:]):
        mine = whole[0][(whole[0] >= low) & (whole[0] < high)]
        assert (mine + windows.digit <= high).all()
        for at in range(low, high - 49):
            digits = (mine[(mine >= at) & (mine < at + windows.spread)] - at).tolist()
            assert digits
            seen.setdefault(bytes(data[at : at + 50]), []).append(digits)
    # a digit that is the lowest of another window may stand in one copy only; some digit stands in all of them
    assert all(set.intersection(*map(set, d)) for d in seen.values()) and any(len(d) > 1 for d in seen.values())


def test_batches_of_a_task_are_packed_together():
    rows = pa.table({"slice": pa.array([0, 1, 2, 3] * 50, pa.int64()), "doc_id": pa.array(range(200), pa.int64()), "text": [f"text {i}" for i in range(200)],
                     "along": pa.nulls(200, pa.struct([("none", pa.int32())]))})
    batches = rows.to_batches(max_chunksize=10)
    alone, together, some = (pa.Table.from_batches(exchange._packed(iter(batches), n)) for n in (0, 1 << 20, 3 * batches[0].nbytes))
    assert (len(alone), len(together)) == (80, 4) and 4 < len(some) < 80
    for slice_ in range(4):
        one, other, third = (exchange.documents(t.filter(pc.equal(t["slice"], slice_))) for t in (alone, together, some))
        assert all(np.array_equal(x, y) and np.array_equal(x, z) for x, y, z in zip(one, other, third)) and len(one[0]) == 50


def test_keys_are_ranked_as_by_distinct():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(0, max(1, n // 2), n).astype(np.uint64) << np.uint64(40)
        assert all(np.array_equal(x, y) for x, y in zip(exchange.ranked(keys), exchange.distinct(keys)))


@pytest.mark.parametrize("source", ["odd", "docs"])
def test_jaccard(source, request):
    df = request.getfixturevalue(source)
    sets = {}
    for d, t in texts_of(df):
        sets.setdefault(d, shingles(t))
    named = sorted(d for d in sets if d is not None)
    links = [(a, b) for a in named for b in named if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = plain_components(named, links)
    for r in ngram_join.jaccard_components(df).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root.get(r.doc_id))


def test_jaccard_of_many_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        text = list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 4))):
            text[j] = f"x{rng.integers(1 << 30)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = plain_components(list(sets), links)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df).collect()} == root


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 480)] + [(1000, i) for i in range(1001, 1200)]
    nodes = {x for p in links if p[0] != p[1] for x in p}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == plain_components(nodes, [p for p in links if p[0] != p[1]])


def test_shards(odd, none, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", F.lit("mine").alias("shard"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"))
        got = sharding.shard_by_bytes(rows, F.col("size"), [F.col("size"), F.col("doc_id")], 8).toPandas()
        assert len(got) == df.count()
        target, largest = got["size"].sum() / 8, got["size"].max()
        sizes = got.groupby("shard")["size"].sum()
        assert (sizes - target).abs().max() <= largest
        for _, own in got.groupby("shard"):
            assert sorted(own.slot) == list(range(len(own)))
    assert sharding.shard_by_bytes(none.select("doc_id"), F.lit(1), [F.col("doc_id")], 8).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [int(x) for x in rng.integers(-3, 4, 6)]) for i in range(120)] + [(7, [1] * 6), (None, [1] * 6), (500, None), (501, [1, 2])]
    got = topk.top_k(spark.createDataFrame(rows, "id long, vector array<long>"), F.col("id") % 20 == 0, 5).collect()
    kept = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 6]
    want = []
    for q, x in kept:
        if q % 20 == 0:
            best = sorted(((-int(x @ y), i) for i, y in kept if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 32))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.03 * (i % 9) * rng.standard_normal(32)], i % 3) for i in range(300)]
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, rows[5][1], None), (904, [1.0, None], 2)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "id long, vector array<double>, label int"), 0.93).collect()
    good = [r for r in rows if r[0] < 900]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    close = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    links = int(close.sum())
    assert 0.9 * links <= sum(r.n_links for r in got) <= links
    root = plain_components([r[0] for r in rows], [(good[i][0], good[j][0]) for i, j in zip(*np.nonzero(close))])
    assert {r.id: r.component_id for r in got} == root
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_packing(odd, none, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (odd, docs):
        rows = packing.pack(packing.token_pieces(df.where("doc_id is not null").dropDuplicates(["doc_id"]), path, 2048), 2048).toPandas()
        for d, t in texts_of(df.dropDuplicates(["doc_id"])):
            if d is None:
                continue
            ids = [*library.encode(t, add_special_tokens=False).ids, 0]
            own = rows[rows.doc_id == d].sort_values("piece")
            assert own.length.tolist() == [len(ids[a : a + 2048]) for a in range(0, len(ids), 2048)]
            assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)]
        for _, own in rows.sort_values("offset").groupby("sequence_id"):
            assert own.length.sum() <= 2048
            assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        assert rows.sequence_id.nunique() <= packing.lower_bound(rows.length.to_numpy(), 2048) + 1
    assert packing.pack(packing.token_pieces(none, path, 2048), 2048).count() == 0


def test_packing_exchange(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rows = [(i, int(x)) for i, x in enumerate(np.random.default_rng(4).integers(300, 1100, 600))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), 2048).toPandas()
    assert sorted(zip(got.doc_id, got.length)) == rows
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() >= packing.lower_bound(got.length.to_numpy(), 2048)


def test_bpe(odd, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df in (odd, docs):
        want = Counter((d, tuple(library.encode(t, add_special_tokens=False).ids), t) for d, t in texts_of(df))
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.round_trip(df, path).collect()) == want
    ids = odd.sparkSession.createDataFrame([(1, [15496, 995]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(ids, path).collect()} == {1: "Hello world", 2: "", 3: ""}


def test_bpe_by_parts():
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(6)
    some = ["".join(rng.choice(list("aeinrst"), int(rng.integers(1, 14)))).encode() for _ in range(3000)]
    assert codec._word_ids(some) == codec.merge(some)


@pytest.mark.parametrize("source", ["odd", "docs"])
def test_word_scores(source, request):
    df = request.getfixturevalue(source)
    rows = [(d, [*words(t), None]) for d, t in texts_of(df)]
    learn = lambda ids: np.array([i % 3 != 0 for i in ids.tolist()], bool)
    count = Counter(w for d, own in rows if ((1 << 63) - 1 if d is None else d) % 3 != 0 for w in own)
    total, kinds = sum(count.values()), len(count)
    want = defaultdict(list)
    for d, own in rows:
        want[d].append((len(own), sum(count[w] > 0 for w in own), sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own)))
    for r in lm_scoring.score(df, learn).collect():
        assert r.train_tokens == total and r.score < 0
        assert any((r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2]) for w in want[r.doc_id])


def test_distinct_strings():
    """Places and counts against numpy's, also where codes share the leading bits that are sorted by."""
    near = (np.arange(4, dtype=np.uint64) * np.uint64(pow(int(lm_scoring.SPREAD), -1, 1 << 64))).view(np.int64) + 7
    rng = np.random.default_rng(9)
    for codes in (near[rng.integers(0, 4, 500)], rng.integers(0, 1 << 56, 3000)[rng.integers(0, 3000, 9000)], near[:1], near[:0]):
        values, place = lm_scoring.distinct(codes)
        want = np.unique(codes, return_inverse=True)
        assert (values == want[0]).all() and (place == want[1]).all()
    texts = [b"a b  abra", b"", " \tÄrger x".encode(), b"abra A", b"\n"]
    content = b"".join([np.arange(5).tobytes(), np.array([len(t) for t in texts]).tobytes(), *texts])
    table = pa.table({"n": [5], "size": [len(content)], "packed": [pa.compress(content, "zstd", asbytes=True)]})
    counted, placed = (lm_scoring._Slice(table, lambda ids: ids != 3) for _ in range(2))
    counted.count_grams()
    placed.read_grams()
    code = lambda b: [int.from_bytes(b[i : i + 7], "big") for i in range(len(b) - 6)]
    plain = [code(bytes([lm_scoring.BEFORE]) * 6 + b" ".join(t.lower().split()) + b"\xff") for t in texts]
    train = Counter(c for i, own in enumerate(plain) if i != 3 for c in own)
    assert placed.grams[placed.gram].tolist() == [c for own in plain for c in own] and placed.sizes.tolist() == [len(x) for x in plain]
    assert counted.grams.tolist() == placed.grams.tolist() and counted.gram_train.tolist() == [train[c] for c in counted.grams.tolist()]


def test_context_tree(spark):
    """Probabilities against the recursion over the whole tree."""
    train, held = b"abracadabra abra", b"abra cab\xff"
    df = spark.createDataFrame([(1, train.decode()), (3, held[:-1].decode())], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score(df, lambda ids: ids == 1).collect()}
    depth = lm_scoring.DEPTH
    pad = bytes([lm_scoring.BEFORE]) * depth
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def decisions(stream):
        for i in range(depth, len(stream)):
            for k in range(7, -1, -1):
                yield i, (256 | stream[i]) >> (k + 1), stream[i] >> k & 1

    stream = pad + train + b"\xff"
    for i, q, bit in decisions(stream):
        for d in range(depth + 1):
            counts[stream[i - d : i], q][bit] += 1
            if d:
                children[stream[i - d + 1 : i], q].add((stream[i - d : i], q))

    def own(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    def block(node):
        e = own(*counts[node])
        return e if len(node[0]) == depth else float(np.logaddexp(math.log(0.5) + e, math.log(0.5) + sum(map(block, children[node]))))

    def chance(context, d, q):
        node = context[len(context) - d :], q
        if node not in counts:
            return 0.5
        n0, n1 = counts[node]
        p = (n1 + 0.5) / (n0 + n1 + 1)
        if d == depth:
            return p
        w = 0.5 * math.exp(own(n0, n1) - block(node))
        return w * p + (1 - w) * chance(context, d + 1, q)

    for doc, text in ((1, train + b"\xff"), (3, held)):
        stream, want = pad + text, 0.0
        for i, q, bit in decisions(stream):
            p = chance(stream[i - depth : i], 0, q)
            want += math.log10(p if bit else 1 - p)
        assert got[doc] == pytest.approx(want, rel=1e-5)


def test_language(odd, none, docs, spark, sf):
    model = langid.train(docs, F.lit(True))
    got = langid.predict(odd, model, odd.columns).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 7, 12)) and 0 <= r.score <= 1
    assert langid.predict(none, langid.train(none, F.lit(True))).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none, F.lit(True))).collect()} == {"und"}
    found = QUERIES["op2_language_id"](spark, sf).join(docs, "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95


def test_quality(odd, none, spark, sf):
    got = quality.score(odd, quality.train(odd, odd.where("doc_id < 7").select("doc_id"), F.lit(True)), odd.columns).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, None).count() == 0
    assert quality.train(none, none.select("doc_id"), F.lit(True)) is None
    larger = sf.replace("sf0.001", "sf0.01")  # the smallest table has few trusted positives
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    found = QUERIES["op7_quality"](spark, larger).join(labels, "doc_id").toPandas()
    good, bad = found[found.quality == 1].score.to_numpy(), found[found.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert found[found.quality == 1].predicted.mean() > 0.97


def test_stages_keep_columns_and_rows(odd, none, spark, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, sf).columns == odd.columns
        assert stage(spark, none, sf).count() == 0
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, odd, sf).collect()}.isdisjoint({2, 3, 7, 12})
    kept = corpus_pipeline.near_duplicates(spark, odd, sf).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 8, 10, 11, 12]
    assert sum(r.doc_id is None for r in kept) == 1
    cut = corpus_pipeline.repeated_passages(spark, odd, sf).collect()
    assert Counter((r.doc_id, r.lang, r.source, r.slice, r.score) for r in cut) == Counter((r[0], r[2], r[3], r[5], r[6]) for r in ODD)
    assert all(r.n_chars == len(r.text) for r in cut)
    assert sum(PASSAGE in r.text for r in cut) == 1
    assert corpus_pipeline.packed(spark, odd, sf).count() >= len(ODD)


def test_texts_that_share_an_id_are_documents_of_their_own(spark, sf):
    other = "another text of more than five words under the same number"
    rows = [(1, PASSAGE, "a"), (1, other, "b"), (1, other, "c"), (2, other, "d"), (3, PASSAGE, "e"), (4, "own words of a fourth text that links with nothing", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for _ in range(2):
        kept = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
        texts = Counter(r.text for r in kept)
        assert texts == {PASSAGE: 1, other: 1, rows[-1][1]: 1}  # one of each group, and no text is lost
        assert {r.doc_id for r in kept if r.text == PASSAGE} <= {1, 3} and {r.doc_id for r in kept if r.text == other} <= {1, 2}
    again = corpus_pipeline.near_duplicates(spark, docs.repartition(5, "source"), sf).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, kept))


def test_pipeline_keeps_clean_documents(spark, sf):
    larger = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{larger}/{n}.parquet") for n in ("documents", "labels"))
    kept = corpus_pipeline.quality_filter(spark, corpus_pipeline.language_id(spark, docs, larger), larger).select("doc_id")
    held = labels.where(fold(5) == 0).join(docs.select("doc_id"), "doc_id")
    of = lambda quality: held.where(f"quality = {quality}")
    assert of(1).join(kept, "doc_id").count() >= 0.95 * of(1).count()
    assert of(0).join(kept, "doc_id").count() <= 0.2 * of(0).count()


def test_pipeline_against_plain_version(spark, sf):
    """The rows of run() from the stages' decisions taken over by plain code where it can express them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality_filter(spark, corpus_pipeline.language_id(spark, docs, sf), sf)
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = plain_components(list(sets), links)
    seen, want = set(), Counter()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, t in ((d, t.encode()) for d, t in rows if root[d] == d):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if t[i : i + 50] in seen:
                gone[i : i + 50] = True
        seen.update(t[i : i + 50] for i in range(len(t) - 49))
        text = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "replace")
        n = len(library.encode(text, add_special_tokens=False).ids) + 1
        want.update((d, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == want


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def plain_features(text):
    """The features of quality.features by plain counting, in its order."""
    raw, size = text.encode(), len(text.encode())
    if not size:
        return [0.0] * 24
    split = text.split()
    lines = text.split("\n")
    kinds = Counter("upper" if 65 <= b <= 90 else "lower" if 97 <= b <= 122 else "digit" if 48 <= b <= 57 else "blank" if b in b" \t\v\f\r\n" else "beyond" if b > 127 else "sign" for b in raw)
    bare = [w.rstrip("!?.,;:*#$%&|-_=+~^@<>/\\\"'()[]{}") for w in split]
    pairs = Counter(zip(split, split[1:]))
    letters, w = max(kinds["upper"] + kinds["lower"] + kinds["beyond"], 1), max(len(split), 1)
    distinct = len(set(split)) / w
    return [
        math.log1p(size), math.log1p(len(split)), math.log1p(len(lines)), kinds["upper"] / letters, kinds["beyond"] / letters, letters / size,
        kinds["digit"] / size, kinds["sign"] / size, kinds["sign"] / w, kinds["blank"] / size, sum(map(len, split)) / w,
        sum(not b for b in bare) / w, sum(len(x) - len(b) >= 2 for x, b in zip(split, bare)) / w, sum(len(x) > len(b) for x, b in zip(split, bare)) / w,
        sum(len(x) > 20 for x in split) / w, distinct, distinct * math.log1p(len(split)), max(Counter(split).values(), default=0) / w,
        sum(a == b for a, b in zip(split, split[1:])) / w, len(pairs) / max(w - 1, 1), max(pairs.values(), default=0) / w,
        len(set(lines)) / len(lines), max(Counter(lines).values()) / len(lines), len(split) / len(lines) / 100,
    ]


def test_quality_scores_against_plain_counting(spark, sf):
    """Every score of the query from plainly counted features and the model's bins, one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), fold(5) != 0)
    want = {}
    for d, t in texts_of(docs):
        f = model.weights[-1]
        for j, x in enumerate(plain_features(t)):
            for k in range(quality.BINS):
                a, b = model.edges[j][k : k + 2]
                f += model.weights[j * quality.BINS + k] * min(max((x - a) / max(b - a, 1e-9), 0), 1)
        want[d] = 1 / (1 + math.exp(-min(max(f, -30), 30)))
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, sf).collect()}
    assert len(got) == len(want) and all(abs(got[d].score - s) < 1e-6 for d, s in want.items())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for d, r in got.items())
    assert 0 < sum(r.predicted for r in got.values()) < len(got)  # also the smallest table rejects something


def test_quality_settles(spark, sf):
    """Draws with replacement, from which a descent that swings ends anywhere."""
    larger = sf.replace("sf0.001", "sf0.1")
    labels = dict(spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "quality").collect())
    table = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text").toArrow()
    x = np.concatenate([quality.features(t) for t in slices(table["text"].combine_chunks(), quality.SLICE)])
    y = np.array([labels.get(i, -1) for i in table["doc_id"].to_pylist()])
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in table["doc_id"].to_pylist()])
    for seed in range(4):
        rng = np.random.default_rng(seed)
        s = quality.fit(x[rng.choice(np.flatnonzero(~held & (y == 1)), 4000)], x[rng.choice(np.flatnonzero(~held), 12000)]).score(x)
        assert (s[held & (y == 1)] >= 0.3).mean() >= 0.95 and (s[held & (y == 0)] < 0.3).mean() >= 0.85


def test_languages_against_plain_kernel(spark, sf):
    """Every score of the query from sets of n-grams and their weights, one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, weights = langid.train(docs, fold(4) != 2)

    def plain(text):
        data = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode())
        held = set()
        for n in langid.LENGTHS:
            for i in range(len(data) - n + 1):
                h = (int.from_bytes(data[i : i + n], "big") + n * 0x9E3779B1) * 0x85EBCA6B & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0xC2B2AE35 & 0xFFFFFFFF
                held.add(h >> 16)
        s = weights[sorted(held)].astype(np.float64).sum(axis=0) / math.sqrt(max(len(held), 1)) + weights[-1]
        return langs[int(s.argmax())], float(np.clip((s.max() + 1) / 2, 0, 1))

    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, sf).collect()}
    rows = texts_of(docs)
    assert len(got) == len(rows)
    for d, t in rows:
        lang, score = plain(t) if re.search(r"[^\W\d_]", t) else ("und", 0.0)
        assert got[d].lang_pred == lang and abs(got[d].score - score) < 1e-4
