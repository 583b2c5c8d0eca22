"""Search strings, cover density, vector pools and their merge against brute force."""

import random
import re
from unittest import mock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.operators import hybrid, lexical, postings, vector
from corpusops.operators import embeddings as emb
from corpusops.operators.embeddings import hash_provider


def brute_clause(tokens, items, forbidden):
    def starts(item):
        return [i for i in range(len(tokens)) if tokens[i : i + len(item)] == item]

    if any(starts(f) for f in forbidden):
        return 0.0
    occ = sorted((p, k) for k, it in enumerate(items) for p in starts(it))
    last, before, score = {}, None, 0.0
    for idx, (p, k) in enumerate(occ):
        last[k] = (p, idx)
        if len(last) == len(items):
            st, xst = min(last.values())
            if st != before:
                score += 0.1 / (1 + (p - st) - (idx - xst))
                before = st
    return score


QUERIES = {
    "q1": ("red fox", [([["red"], ["fox"]], [])]),
    "q2": ('"red fox" dog', [([["red", "fox"], ["dog"]], [])]),
    "q3": ("fox or dog -cat", [([["fox"]], []), ([["dog"]], [["cat"]])]),
    "q4": ("fox", [([["fox"]], [])]),
    "q5": ('-cat fox fox "dog red"', [([["fox"], ["dog", "red"]], [["cat"]])]),
}


def corpus(n=120):
    rnd = random.Random(3)
    words = ["red", "fox", "dog", "cat", "sun", "moon"]
    return {f"c{i:03d}": [rnd.choice(words) for _ in range(rnd.randint(0, 25))] for i in range(n)}


def test_text_score_matches_brute_force(spark):
    docs = corpus()
    chunks = spark.createDataFrame([(k, " ".join(v).title() + "!") for k, v in docs.items()], "chunk_id string, text string")
    asked = spark.createDataFrame([(k, t) for k, (t, _) in QUERIES.items()], "query_id string, text string")
    batch = {(r[0], r[1]): r[2] for r in lexical.text_matches(chunks, asked).collect()}
    for q, (text, parsed) in QUERIES.items():
        single = {r[0]: r[1] for r in chunks.select("chunk_id", lexical.text_score(F.col("text"), F.lit(text))).collect()}
        for c, tokens in docs.items():
            want = sum(brute_clause(tokens, i, f) for i, f in parsed)
            assert abs(single[c] - want) < 1e-9, (q, c)
            assert abs(batch.get((q, c), 0.0) - want) < 1e-9, (q, c)


def test_word_index_matches_brute_force(spark, tmp_path):
    """Places of every word, and the same scores from the index as from the texts; null, empty and wordless texts too.

    A stretch of 40 words, so that words stand in many rows."""
    docs = corpus()
    texts = [(k, " ".join(v).title() + "!") for k, v in docs.items()] + [("n", None), ("e", ""), ("p", "... !"), ("u", "École 42 école")]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)
    index = postings.write_index(chunks, str(tmp_path / "index"), 40)
    got = {(r["word"], r["chunk_id"]): list(r["places"]) for r in postings.postings(index.words).collect()}
    want = {}
    for k, v in [*docs.items(), ("u", ["école", "42", "école"])]:
        for i, w in enumerate(v):
            want.setdefault((w, k), []).append(i)
    assert got == want
    assert index.words.where("word = 'fox'").count() > 3
    counted = {r["word"]: r["chunks"] for r in index.counts.collect()}
    assert counted == {w: sum(1 for x, _ in want if x == w) for w, _ in want}
    extra = {"q6": ('"fox red fox" or -sun "moon moon"', [([["fox", "red", "fox"]], []), ([["moon", "moon"]], [["sun"]])]),
             "q7": ("nosuchword fox", [([["nosuchword"], ["fox"]], [])]), "q8": ('fox -"red fox"', [([["fox"]], [["red", "fox"]])]),
             "q9": ("-fox", [])}
    every = {**QUERIES, **extra}
    asked = spark.createDataFrame([(k, t) for k, (t, _) in every.items()], "query_id string, text string")
    for named, few in ((postings.NAMED_WORDS, postings.BROADCAST_ROWS), (2, 3)):
        with mock.patch.multiple(postings, NAMED_WORDS=named, BROADCAST_ROWS=few):
            found = {(r[0], r[1]): r[2] for r in postings.index_matches(index, asked).collect()}
        scores = {(q, c): sum(brute_clause(t, i, f) for i, f in parsed) for q, (_, parsed) in every.items() for c, t in docs.items()}
        assert found == pytest.approx({k: v for k, v in scores.items() if v > 0})
    some = spark.createDataFrame([(f"c{i:03d}",) for i in range(0, 120, 3)], "chunk_id string")
    fewer = {(r[0], r[1]) for r in postings.index_matches(index, asked, some).collect()}
    assert fewer == {(q, c) for q, c in found if int(c[1:]) % 3 == 0}


def test_word_index_opens_only_the_words_of_the_search(spark, tmp_path):
    chunks = spark.range(2000).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("all w"), F.col("id")).alias("text"))
    index = postings.write_index(chunks, str(tmp_path / "index"))
    asked = spark.createDataFrame([("a", "w17"), ("b", "w17 all")], "query_id string, text string")
    rows = postings._of(index.words, spark.createDataFrame([("w17",)], "word string"))
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,w17)]" in rows._jdf.queryExecution().toString()
    assert [(r[0], r[1]) for r in postings.index_matches(index, asked).orderBy("query_id").collect()] == [("a", "17"), ("b", "17")]
    none = postings.write_index(chunks.limit(0), str(tmp_path / "none"))
    assert postings.index_matches(none, asked).count() == 0


def test_query_terms(spark):
    asked = spark.createDataFrame([("a", 'Big "Red Fox" or -cat dog')], "query_id string, text string")
    got = {tuple(r)[1:] for r in lexical.query_terms(asked).collect()}
    assert got == {(0, "word", "big"), (0, "phrase", "red fox"), (1, "not", "cat"), (1, "word", "dog")}


def test_zero_scores_fill_the_pool(spark):
    docs = corpus(30)
    chunks = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "red fox sun moon dog cat")], "query_id string, text string")
    one = [tuple(r) for r in lexical.text_topk(chunks, "red fox sun moon dog cat", 20).collect()]
    many = sorted(
        ((r["chunk_id"], r["text_score"]) for r in lexical.text_topk_batch(chunks, asked, 20).collect()),
        key=lambda r: (-r[1], r[0]),
    )
    assert len(one) == 20 and [r[0] for r in one] == [r[0] for r in many]


def vectors(spark, n, dim, seed):
    rnd = np.random.default_rng(seed)
    m = rnd.normal(size=(n, dim))
    m[5] = m[6]
    rows = [(f"v{i:03d}", [float(x) for x in r]) for i, r in enumerate(m)]
    return m, spark.createDataFrame(rows, "chunk_id string, embedding array<double>")


def test_vector_pools_are_exact(spark):
    m, chunks = vectors(spark, 90, 12, 1)
    q, _ = vectors(spark, 25, 12, 2)
    asked = spark.createDataFrame([(f"q{i}", [float(x) for x in r]) for i, r in enumerate(q)], "query_id string, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    shared = vector.vector_topk_batch(chunks, asked, 7, 12)
    tiled = vector.vector_topk_batch(chunks, asked, 7, 12, tile_rows=20, tile_queries=6)
    for df in (shared, tiled):
        got = {}
        for r in df.collect():
            got.setdefault(r["query_id"], []).append((r["chunk_id"], r["vector_score"]))
        for i, v in enumerate(q):
            s = np.maximum(unit @ (v / np.linalg.norm(v)), 0)
            want = sorted(range(len(m)), key=lambda j: (-round(s[j], 12), j))[:7]
            assert {c for c, _ in got[f"q{i}"]} == {f"v{j:03d}" for j in want}
    single = [r["chunk_id"] for r in vector.vector_topk(chunks, [float(x) for x in q[3]], 7).collect()]
    assert set(single) == {r["chunk_id"] for r in shared.filter("query_id = 'q3'").collect()}


def test_short_and_missing_vectors(spark):
    chunks = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [1.0]), ("c", None), ("d", [0.0, 1.0, 9.0]), ("e", [None, 1.0])],
        "chunk_id string, embedding array<double>",
    )
    got = {r[0]: round(r[1], 6) for r in vector.vector_topk(chunks, [1.0, 0.0], 9).collect()}
    assert got == {"a": 1.0, "b": 1.0, "d": 0.0, "e": 0.0}


def test_hybrid_keeps_zero_for_the_other_side(spark):
    chunks = spark.createDataFrame(
        [("docs", "a", "red fox", [1.0, 0.0]), ("docs", "b", "sun", [0.9, 0.1]), ("docs", "c", "red fox red", None),
         ("lsp", "d", "red fox", [1.0, 0.0])],
        "domain string, chunk_id string, text string, embedding array<double>",
    )
    got = [(r["chunk_id"], round(r["score"], 4)) for r in hybrid.hybrid_search(chunks, "red fox", [1.0, 0.0]).collect()]
    # 'red fox red' has two minimal covers
    assert got == [("a", 0.775), ("b", 0.7454), ("c", 0.05)]
    assert hybrid.hybrid_search(chunks, "  ", [1.0, 0.0]).count() == 0


def test_limits_and_weights():
    assert [hybrid.clamp_top_k(k) for k in (None, 0, 99)] == [8, 1, 30]
    assert [hybrid.pool_size(8, p) for p in (None, 3, 9999)] == [80, 8, 500]
    assert hybrid.weights("docs", {}) == (0.75, 0.25)
    assert hybrid.weights("lsp", {"WEIGHT_VECTOR": "0.5", "WEIGHT_TEXT_LSP": "0.1", "WEIGHT_TEXT": ""}) == (0.5, 0.1)


def test_provider_matches_expression(spark):
    from corpusops.operators.embeddings import embed_rows, hash_embedding

    df = spark.createDataFrame([("a", "héllo"), ("b", " "), ("c", None)], "id string, t string")
    out = {r["id"]: r["embedding"] for r in embed_rows(df, "t", hash_provider(70), 70).collect()}
    assert out["b"] is None and out["c"] is None
    assert out["a"] == df.filter("id = 'a'").select(hash_embedding(F.col("t"), 70)).first()[0]
    assert re.match(r"^-?\d", str(out["a"][0]))


def test_embedding_holds_few_vectors_at_once():
    """A frame of many rows leaves in slices of some batches, blank texts without a vector, order and calls as before."""
    calls, made = [], []

    class Rows:
        schema = T.StructType([T.StructField("text", T.StringType())])

        def mapInPandas(self, run, schema):
            made.append(run)

    def provider(texts):
        calls.append(len(texts))
        return [[float(len(t))] for t in texts]

    emb.embed_rows(Rows(), "text", provider, dim=2, batch=4)
    frame = pd.DataFrame({"text": [" " if i % 10 == 0 else "x" * i for i in range(100)]})
    out = list(made[0](iter([frame])))
    assert max(map(len, out)) == 4 * emb.BATCHES_HELD and max(calls) == 4
    got = [None if v is None else list(v) for part in out for v in part["embedding"]]
    assert got == [None if i % 10 == 0 else [float(i), 0.0] for i in range(100)]
