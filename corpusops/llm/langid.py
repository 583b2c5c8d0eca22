"""Language identification with blended-spectrum string kernels, Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.llm.ragged import result_schema, slices, small_batches, with_results, with_text

#: N-gram lengths in bytes of lower-cased text, and the number of hashed n-gram features.
LENGTHS, FEATURES = (1, 2, 3, 4), 1 << 16
#: Documents per language that the classifier is fitted on, and how many of them are landmarks.
FITTED, LANDMARKS = 400, 40
RIDGE = 1e-3
#: Texts in one matrix product.
ROWS = 32
UNKNOWN = "und"


def presence(texts: pa.Array) -> Iterator[np.ndarray]:
    """0/1 matrices of the n-grams that occur in each text, ROWS texts at a time.

    Letters are lower-cased, and digits, signs and blanks count as one blank each.
    """
    low = pc.utf8_lower(texts)
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    raw = np.frombuffer(low.buffers()[2] or b"", np.uint8)
    for a in range(0, len(low), ROWS):
        bounds = offsets[a : a + ROWS + 1]
        data = PLAIN[raw[bounds[0] : bounds[-1]]]
        owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
        out = np.zeros((len(bounds) - 1) * FEATURES, np.uint8)
        code = np.zeros(len(data), np.uint32)
        for n in LENGTHS:
            if len(data) < n:
                break
            code = code[: len(data) - n + 1] << np.uint32(8) | data[n - 1 :]
            same = owner[: len(code)] == owner[n - 1 :]
            mixed = (code + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0xC2B2AE35)
            out[owner[: len(code)][same] * FEATURES + (mixed >> np.uint32(16))[same]] = 1
        yield out.reshape(-1, FEATURES)


PLAIN = np.arange(256, dtype=np.uint32)
PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = ord(" ")


def _rows(packed: list[bytes]) -> np.ndarray:
    x = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in packed]).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(packed: list[bytes], labels: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and one weight column each, from packed 0/1 rows and their languages.

    The kernel of two texts is the number of n-grams in both over the root of the product of their numbers.
    The first LANDMARKS rows of each language are the landmarks; K(x, landmarks) K(landmarks)^-1/2 are the
    Nystroem features, on which one ridge regression per language (1 against -1) is solved. The kernel is
    a product of feature rows, so the solution is returned as weights on them.
    """
    langs = sorted(set(labels))
    labels_at = np.array([langs.index(x) for x in labels])
    marks = _rows([packed[i] for k in range(len(langs)) for i in np.flatnonzero(labels_at == k)[:LANDMARKS]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.concatenate([_rows(packed[a : a + 100]) @ marks.T for a in range(0, len(packed), 100)])
    z = np.hstack([kernel @ root, np.ones((len(packed), 1))])
    target = np.where(labels_at[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1 / np.bincount(labels_at, minlength=len(langs))[labels_at]  # languages count alike
    left = z.T * weight
    solved = np.linalg.solve(left @ z + RIDGE * np.eye(z.shape[1]), left @ target)
    weights = np.zeros((FEATURES + 1, len(langs)), np.float32)
    weights[:FEATURES] = marks.T @ (root @ solved[:-1])
    weights[FEATURES] = solved[-1]
    return langs, weights


def sampled(docs: DataFrame, by: str, each: int) -> DataFrame:
    """doc_id and ``by`` of at most ``each`` rows per value of ``by``, the lowest by a hash of doc_id.

    The lowest are taken in 64 parts of each value first, so a common value is not one task's work.
    """
    ids = docs.select("doc_id", by, F.xxhash64("doc_id").alias("_hash")).withColumn("_part", F.col("_hash") % 64)
    for keys in ([by, "_part"], [by]):
        order = Window.partitionBy(*keys).orderBy("_hash", "doc_id")
        ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each)
    return ids.select("doc_id", by)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, training: Column) -> tuple[list[str], np.ndarray]:
    """Languages and weights, from at most FITTED documents per language for which ``training`` holds.

    One task fits them from those rows and sends nothing else.
    """
    usable = small_batches(docs).where(training & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter(F.col("text")))
    chosen = sampled(usable, "lang", FITTED).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(row).tobytes() for texts in slices(batch.column("text")) for block in presence(texts) for row in block]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_lang"), pa.array(bits, pa.binary())], names=["id", "lang", "bits"])

    def fitted(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("lang", "id", "bits"))))
        langs, weights = fit([bits for _, _, bits in rows], [lang for lang, _, _ in rows])
        return pa.table({"langs": pa.array([langs], pa.list_(pa.string())), "weights": pa.array([weights.tobytes()], pa.binary())})

    found = (
        usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
        .select("_id", "_lang", "text").mapInArrow(packed, "id long, lang string, bits binary")
        .groupBy(F.lit(0).alias("all")).applyInArrow(fitted, "langs array<string>, weights binary").collect()
    )
    if not found:
        return [], np.zeros((FEATURES + 1, 0), np.float32)
    return list(found[0].langs), np.frombuffer(found[0].weights, np.float32).reshape(FEATURES + 1, -1)


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray], carried: list[str] = (), names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """doc_id, lang_pred, score (named by ``names``) and the columns ``carried`` for every row of ``docs`` (doc_id, text).

    score is the best regression value, brought from [-1, 1] to [0, 1] and cut there. A text that is null or
    has no letter, and any text where nothing was learnt, is UNKNOWN with score 0. Whole texts are scored, by
    one matrix product per ROWS texts; repeated rows and null ids are kept. A carried column with the name of a
    result is left out.
    """
    langs, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # FEATURES x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            found = []
            for texts in slices(batch.column(0)):
                for block in presence(texts):
                    x = block.astype(np.float32)
                    norms = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
                    found.append((x @ w[:FEATURES]) / norms + w[FEATURES])
            s = np.concatenate(found) if found else np.zeros((0, len(langs)))
            known = batch.column(1).to_numpy(zero_copy_only=False) & bool(langs)
            best = s.argmax(axis=1) if langs else np.zeros(len(s), int)
            top = s.max(axis=1) if langs else np.zeros(len(s))
            lang = np.array([*langs, UNKNOWN], object)[np.where(known, best, len(langs))]
            score = np.where(known, np.clip((top.astype(np.float64) + 1) / 2, 0, 1), 0.0)
            yield with_results(batch, schema.names, pa.array(lang, pa.string()), pa.array(score))

    rows, wanted = with_text(docs, carried, names, has_letter(F.col("text")))
    schema = result_schema(rows.select(*wanted), **dict(zip(names, ("string", "double"))))
    return rows.mapInArrow(run, schema)
