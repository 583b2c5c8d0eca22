"""Importance resampling towards a target corpus, on hashed n-gram features, by Arrow kernels.

Texts are lower-cased, split into words, flattened and dictionary-encoded by Arrow's kernels. Shifted dictionary
indices form the n-grams; only the distinct ones are spelled out and hashed into buckets, and taking
bucket numbers by index and adding them up by segment gives counts and weights of whole batches at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusops.llm.ragged import result_schema, slices, small_batches, with_results, with_text
from corpusops.session import stored

#: Lower-case letters, digits and everything beyond ASCII make words; all else divides them.
DIVIDER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text worked on at a time.
SLICE = 2 << 20


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Text and dictionary index of every word, and the dictionary."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), DIVIDER)
    owner = pc.list_parent_indices(parts).to_numpy()
    coded = pc.list_flatten(parts).dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    spelled = coded.dictionary.cast(pa.large_binary()).to_pylist()
    real = np.array([len(w) > 0 for w in spelled], bool)[index] if len(index) else np.empty(0, bool)  # dividers at an edge leave empty ones
    return owner[real], index[real], spelled


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of every run of 1 to ``longest`` words, and the number of words of each text."""
    owner, index, spelled = words_of(texts)
    owners, hashed = [], []
    grams, code, kinds = [(w,) for w in range(len(spelled))], index, len(spelled)
    for n in range(1, longest + 1):
        if n > 1:  # a run and the word behind it, where both are of one text
            a = max(len(index) - n + 1, 0)
            same = owner[:a] == owner[n - 1 : n - 1 + a]
            pair = np.where(same, code[:a] * kinds + index[n - 1 : n - 1 + a], -1)
            distinct, code = np.unique(pair, return_inverse=True)
            grams = [() if p < 0 else (*grams[p // kinds], p % kinds) for p in distinct.tolist()]
            owners.append(owner[:a][same])
        else:
            same = slice(None)
            owners.append(owner)
        bucket = np.array([zlib.crc32(b" ".join(spelled[w] for w in g)) % buckets for g in grams], np.int64)
        hashed.append(bucket[code][same] if len(code) else np.empty(0, np.int64))
    return np.concatenate(owners), np.concatenate(hashed), np.bincount(owner, minlength=len(texts))


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts of ``docs`` by bucket; a task sends one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0), SLICE):
                total += np.bincount(features(texts, longest, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = small_batches(docs).select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # one row per bucket at most
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of each bucket's smoothed share in the target to that in the source, rounded down."""
    k = len(target)
    s_all, t_all = int(source.sum()), int(target.sum())
    ratio = [(t + 1) * (s_all + k) / ((s + 1) * (t_all + k)) for t, s in zip(target.tolist(), source.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int, carried: list[str] = ()) -> DataFrame:
    """doc_id, the columns ``carried``, n_words, n_features and weight (the mean gain of the features, rounded down; 0 without any)."""
    rows, wanted = with_text(docs, carried, ("n_words", "n_features", "weight"))
    schema = result_schema(rows.select(*wanted), n_words="long", n_features="long", weight="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts in slices(batch.column(0), SLICE):
                owner, bucket, n_words = features(texts, longest, len(gain))
                order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
                upto = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                n = np.bincount(owner, minlength=len(texts))
                ends = np.cumsum(n)
                found.append(np.stack([n_words, n, (upto[ends] - upto[ends - n]) // np.maximum(n, 1)]))
            columns = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
            yield with_results(batch, schema.names, *[pa.array(c.astype(np.int64)) for c in columns])

    return rows.mapInArrow(run, schema)


def noise(seed: int):
    """A thousand Gumbel draws' worth of noise, rounded down, decided by doc_id: floor(-1000 ln(-ln((h + 0.5) / 2^32)))."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list, drawn: int) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ...) for the first ``drawn`` in ``order`` and null for the rest.

    Rows are put in order by a range partitioning that is written once. The numbers of rows per partition
    (as many as partitions) say where each begins, and a window inside the partition says the rest.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "by_score")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    placed = ranged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("rank", place)  # one row per partition
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")).drop("_part", "_before")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Features are all runs of 1 to ``longest`` words, hashed into ``buckets``. The weight is the mean gain of a
    document's features and the score adds Gumbel noise, so the documents of highest score are a draw without
    replacement in proportion to the importance weights. Of the documents with ``least_words`` words, ``percent`` per
    cent are drawn, by score, ties to the smaller doc_id; ``rank`` is their order and null for all others.

    A null text has no features and weight 0. A null doc_id counts as an empty name and goes behind other ids
    in ties; rows that repeat a doc_id are drawn each on its own. An empty target leaves every target count at 0.
    Other columns are not read. Only the counts per bucket reach the driver.
    """
    gain = gains(bucket_counts(target, longest, buckets), bucket_counts(docs, longest, buckets))
    scored = stored(
        weighted(docs, gain, longest).select(
            F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score")
        ),
        "scored",
    )
    enough = F.col("n_words") >= least_words
    fit = scored.where(enough)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    drawn = ranked(fit, order, percent * fit.count() // 100)
    return drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")
