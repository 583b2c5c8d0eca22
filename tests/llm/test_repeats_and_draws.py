"""op11 to op13 against plain versions: on the given tables, on odd rows and on made-up texts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusops.llm import exchange, periodic_runs, resampling, substring_dedup
from corpusops.llm.queries import QUERIES
from tests.llm.test_operators import ODD, SCHEMA, WORD, texts_of

FEATURE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_removal(rows, window):
    """(doc_id, number of words, removed, kept words, removed runs) per row of (doc_id, text)."""
    split = [(math.inf if d is None else d, d, WORD.findall(t or "")) for d, t in rows]
    lowest = {}
    for key, _, own in split:
        for i in range(len(own) - window + 1):
            w = tuple(own[i : i + window])
            lowest[w] = min(lowest.get(w, math.inf), key)
    out = []
    for key, d, own in split:
        gone, seen = [False] * len(own), set()
        for i in range(len(own) - window + 1):
            w = tuple(own[i : i + window])
            if lowest[w] < key or w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        edges = [i for i in range(len(own)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((d, len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g), tuple(edges)))
    return out


def removed(df, window):
    return [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode(), tuple(r.starts)) for r in substring_dedup.remove_repeats(df, window).collect()]


@pytest.mark.parametrize("window", [1, 4, 20])
def test_substring_dedup_of_odd_rows(odd, window):
    got = removed(odd, window)
    assert Counter(got) == Counter(plain_removal(texts_of(odd), window))


def test_substring_dedup_of_made_up_texts(spark):
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for d in rng.permutation(240).tolist():
        own = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(0, 90)))]
        if d % 3 == 0:  # a hot passage, whole, in part, and twice
            a, b = sorted(rng.integers(0, 61, 2).tolist())
            own[10:10] = passage[a:b]
            own += passage[a:b] if d % 2 else []
        if d % 5 == 0:
            own += ["same"] * int(rng.integers(1, 70))
        rows.append((d, " ".join(own)))
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(removed(df, 20)) == Counter(plain_removal(rows, 20))
    assert Counter(removed(df, 7)) == Counter(plain_removal(rows, 7))


def test_windows_of_one_key_are_told_apart():
    keys, check = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint32)
    member, place = substring_dedup.told_apart(keys, check)
    assert keys[member].tolist() == [5, 5, 9] and place.tolist() == [0, 1, 0, 2]
    first = np.array([(3, 1), (1, 2), (2, 1)], substring_dedup.FIRST)
    assert substring_dedup._earlier(np.array([5], np.uint64), np.zeros(3, np.int64), first).tolist() == [True, False, False]


def test_empty_tables(none):
    assert substring_dedup.remove_repeats(none).count() == 0
    assert resampling.resample(none, none).count() == 0
    assert periodic_runs.find_runs(none, carried=none.columns).count() == 0


def test_op11(spark, sf):
    rows = texts_of(spark.read.parquet(f"{sf}/documents.parquet"))
    got = QUERIES["op11_substring_dedup"](spark, sf).collect()
    want = [(d, n, k, sha256(text)) for d, n, k, text, _ in plain_removal(rows, 20)]
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(want)
    assert any(r.n_removed for r in got)


def plain_draw(rows, target, longest, buckets, percent, least, seed):
    def parts(text):
        own = FEATURE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return own, [" ".join(own[i : i + n]) for n in range(1, longest + 1) for i in range(len(own) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in parts(t)[1])
    t = Counter(bucket(f) for x in target for f in parts(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for d, text in rows:
        own, grams = parts(text)
        g = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in map(bucket, grams)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(own), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[2]))
    drawn = fit[: percent * len(fit) // 100]
    return Counter([(*r, i + 1) for i, r in enumerate(drawn)] + [(*r, None) for r in fit[len(drawn):]] + [(*r, None) for r in out if r[1] < least])


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling(odd, longest):
    target = odd.where("doc_id in (1, 4, 10)")
    rows = texts_of(odd)
    got = resampling.resample(odd, target, longest, 97, 50, 2, 7).collect()
    want = plain_draw(rows, [t for d, t in rows if d in (1, 4, 10)], longest, 97, 50, 2, 7)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == Counter(tuple(np.delete(np.array(k, object), 1)) for k in want.elements())


def test_resampling_keeps_tied_scores_in_order(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(200)] + [(None, 1)], "doc_id long, score long").repartition(7)
    got = resampling.ranked(rows, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], 90).collect()
    order = sorted(((i, i % 3) for i in range(200)), key=lambda r: (-r[1], r[0]))
    order.insert(sum(s == 2 for _, s in order) + sum(s == 1 for _, s in order), (None, 1))
    want = {r: i + 1 if i < 90 else None for i, r in enumerate(order)}
    assert {(r.doc_id, r.score): r["rank"] for r in got} == want


def plain_runs(words, min_length, exponent):
    n, spans = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(min_length, exponent * q) and not any((a, i + q - a) == (s, length) for s, length, _ in spans):
                spans.add((a, i + q - a, q))  # a multiple of the smallest period covers the same words
    return sorted((s, length, q) for s, length, q in spans)


def plain_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def runs_in(texts, min_length=24, exponent=3):
    found = periodic_runs._found(pa.array(texts, pa.large_string()), min_length, exponent)
    return [c.to_pylist() for c in found]


@pytest.mark.parametrize(("min_length", "exponent"), [(24, 3), (1, 2), (5, 2), (7, 4)])
def test_runs_of_made_up_texts(min_length, exponent):
    rng = np.random.default_rng(13)
    texts = []
    for _ in range(250):
        own = []
        while len(own) < int(rng.integers(1, 160)):
            part = [str(x) for x in rng.integers(0, 3, int(rng.integers(1, 9)))]
            own += part * int(rng.integers(1, 12))
            own = own[: len(own) - int(rng.integers(0, 3))]
        texts.append(" ".join(own))
    texts += ["", " \n", "a", "x " * 500, "a b " * 40 + "a " * 40 + "b a " * 30, " ".join("abaab" * 30)]
    n_words, runs, strongest, collapsed = runs_in(texts, min_length, exponent)
    for text, n, found, best, kept in zip(texts, n_words, runs, strongest, collapsed):
        own = WORD.findall(text)
        want = plain_runs(own, min_length, exponent)
        assert n == len(own) and [(r["start"], r["length"], r["period"]) for r in found] == want
        assert kept.decode() == plain_collapse(own, want)
        if want:
            top = max(want, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
            assert (best["start"], best["length"], best["period"]) == top
        else:
            assert best is None


def test_runs_of_odd_rows(odd):
    got = periodic_runs.find_runs(odd, carried=["text", "n_words", "slice"]).collect()
    assert Counter((r.doc_id, r.slice) for r in got) == Counter((r[0], r[5]) for r in ODD)
    for r in got:
        own = WORD.findall(r.text or "")
        if len(own) < 1000:
            assert [tuple(x) for x in r.runs] == plain_runs(own, 24, 3)
    (long,) = [r for r in got if r.doc_id == 11]
    assert [tuple(x) for x in long.runs] == [(0, 30000, 1)] and bytes(long.collapsed).decode() == "long " + "x" * 5000


def test_op13(spark, sf):
    rows = texts_of(spark.read.parquet(f"{sf}/documents.parquet"))
    want = {}
    for d, t in rows:
        own = WORD.findall(t)
        h, n = zlib.crc32(str(d).encode()), len(own)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(own, 24, 3)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want[d] = (len(runs), *best, milli, sha256(lines), sha256(plain_collapse(own, runs)))
    got = QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)
    assert sum(r.n_runs > 0 for r in got) >= len(rows) / 20


def test_second_fingerprint_travels():
    extra = np.array([(1, 2), (exchange.LAST_ID, 4)], substring_dedup.FIRST)
    assert exchange.from_bytes(exchange.to_bytes(extra), substring_dedup.FIRST, 2).tolist() == extra.tolist()
