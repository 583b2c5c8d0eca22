"""Quality classifier learnt from trusted positives and unlabelled texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.llm.ragged import result_schema, slices, small_batches, with_results, with_text

#: Trusted positives and unlabelled documents that the classifier is fitted on.
POSITIVES, UNLABELLED = 4000, 12000
BINS, STEPS, RATE, RIDGE = 10, 400, 0.05, 1e-2
#: Smallest share of the positives in the region that the class prior is read from.
REGION = 0.5
#: The class prior where there is too little to read it from, and how far off it may well be.
EXPECTED, EXPECTED_ERROR = 0.8, 0.1

#: Bytes of text worked on at a time.
SLICE = 2 << 20

UPPER, LOWER, DIGIT, BLANK, LINE, SIGN, BEYOND = range(7)
KINDS = np.full(256, SIGN, np.uint8)
for _kind, _bytes in ((UPPER, range(65, 91)), (LOWER, range(97, 123)), (DIGIT, range(48, 58)), (BLANK, b" \t\v\f\r"), (LINE, b"\n"), (BEYOND, range(128, 256))):
    KINDS[list(_bytes)] = _kind


def _per_row(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _distinct(owner: np.ndarray, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values and the highest count of one, per row."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    keys, counts = np.unique(owner.astype(np.int64) << 32 | index, return_counts=True)
    rows = keys >> 32
    most = np.zeros(n)
    np.maximum.at(most, rows, counts)
    return np.bincount(rows, minlength=n).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """Shape and repetition of whole texts, one row each; an empty text is all zero."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    kinds = KINDS[data]
    filled = np.flatnonzero(size)
    count = np.zeros((n, 7))
    for k in range(7) if len(filled) else ():
        count[filled, k] = np.add.reduceat(kinds == k, (offsets - offsets[0])[filled], dtype=np.int64)
    words = pc.utf8_split_whitespace(texts)
    owner = pc.list_parent_indices(words).to_numpy()
    coded = words.flatten().dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    spelled = coded.dictionary
    blank = pc.binary_length(spelled).to_numpy() == 0
    real = ~blank[index]
    owner, index = owner[real], index[real]
    length = pc.utf8_length(spelled).to_numpy().astype(float)
    unsigned = pc.utf8_length(pc.utf8_rtrim(spelled, "!?.,;:*#$%&|-_=+~^@<>/\\\"'()[]{}")).to_numpy()
    trailing = length - unsigned
    n_words = np.bincount(owner, minlength=n).astype(float)
    distinct, most = _distinct(owner, index, n)
    follows = owner[1:] == owner[:-1]
    again = _per_row((index[1:] == index[:-1])[follows].astype(float), owner[1:][follows], n)
    pairs, most_pair = _distinct(owner[1:][follows], (index[1:] * 1_000_003 + index[:-1])[follows] & 0xFFFFFFFF, n)
    lines = pc.split_pattern(texts, "\n")
    line_owner = pc.list_parent_indices(lines).to_numpy()
    line_kinds, most_lines = _distinct(line_owner, lines.flatten().dictionary_encode().indices.to_numpy().astype(np.int64), n)
    n_lines = np.bincount(line_owner, minlength=n).astype(float)
    one = np.maximum
    letters = one(count[:, UPPER] + count[:, LOWER] + count[:, BEYOND], 1)
    w = one(n_words, 1)
    rows = np.stack([
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines),
        count[:, UPPER] / letters, count[:, BEYOND] / letters, letters / one(size, 1), count[:, DIGIT] / one(size, 1),
        count[:, SIGN] / one(size, 1), count[:, SIGN] / w, (count[:, BLANK] + count[:, LINE]) / one(size, 1),
        _per_row(length[index], owner, n) / w,
        _per_row((unsigned[index] == 0).astype(float), owner, n) / w,
        _per_row((trailing[index] >= 2).astype(float), owner, n) / w,
        _per_row((trailing[index] >= 1).astype(float), owner, n) / w,
        _per_row((length[index] > 20).astype(float), owner, n) / w,
        distinct / w, distinct / w * np.log1p(n_words), most / w, again / w, pairs / one(w - 1, 1), most_pair / w,
        line_kinds / one(n_lines, 1), most_lines / one(n_lines, 1), n_words / one(n_lines, 1) / 100,
    ], axis=1)
    rows[size == 0] = 0
    return rows


@dataclass
class Model:
    """Bin edges of each feature and the weight of each bin; the last weight is the constant."""

    edges: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """Share of each bin's range that a value has passed, so a weight is a slope inside its bin."""
        width = np.maximum(np.diff(self.edges, axis=1), 1e-9)
        passed = np.clip((x[:, :, None] - self.edges[None, :, :-1]) / width, 0, 1).reshape(len(x), -1)
        return np.hstack([passed, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.design(x) @ self.weights)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _descend(size: int, gradient: Callable, risk: Callable) -> np.ndarray:
    """Adam from zero with steps that fade out; of every tenth iterate the one of lowest ``risk``."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    best, lowest = w, np.inf
    for t in range(1, STEPS + 1):
        g = gradient(w) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = RATE * (1 + np.cos(np.pi * t / STEPS)) / 2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t % 10 == 0 and (now := risk(w)) < lowest:
            best, lowest = w, now
    return best


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores that rank positives high.

    In any region the unlabelled hold at least prior times the positives' share, and just that where no
    negative scores. So it is the smallest ratio of the two shares over the regions above a threshold that hold
    REGION of the positives or more. It is weighed against EXPECTED by the sampling error of the ratio and by
    EXPECTED_ERROR: below some 100 positives the expectation counts most.
    """
    cuts = np.quantile(p, np.linspace(0, 1 - REGION, 50))
    in_p = np.maximum((p[:, None] >= cuts).mean(axis=0), 1e-9)
    in_u = (u[:, None] >= cuts).mean(axis=0)
    ratio = in_u / in_p
    error = np.sqrt(in_u * (1 - in_u) / len(u) + ratio**2 * in_p * (1 - in_p) / len(p)) / in_p
    at = np.argmin(ratio + error)
    weight = np.array([max(error[at], 1e-6), EXPECTED_ERROR]) ** -2.0
    return float(np.clip(weight @ [ratio[at], EXPECTED] / weight.sum(), 0.05, 0.99))


def _risks(prior: float, fp: np.ndarray, fu: np.ndarray) -> tuple[float, float]:
    """Both parts of the unbiased risk with the logistic loss: as positive, as negative."""
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def _clamped(prior: float, fp: np.ndarray, fu: np.ndarray) -> float:
    as_positive, as_negative = _risks(prior, fp, fu)
    return as_positive + max(0.0, as_negative)


def _scale(prior: float, fp: np.ndarray, fu: np.ndarray) -> tuple[float, float]:
    """Factor and zero point of a score: of those of about the lowest clamped risk, the one whose mean
    probability over the unlabelled comes closest to the prior."""
    tried = []
    for factor in np.geomspace(1, 16, 9) / (fu.std() + 1e-9):
        for zero in np.quantile(fu, np.linspace(0, 0.5, 51)):
            x, y = factor * (fp - zero), factor * (fu - zero)
            tried.append((_clamped(prior, x, y), abs(_sigmoid(y).mean() - prior), factor, zero))
    lowest = min(t[0] for t in tried)
    return min((t for t in tried if t[0] <= lowest + max(0.003, 0.05 * lowest)), key=lambda t: t[1])[2:]


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Minimises the non-negative unbiased risk with the logistic loss.

    The rows are cut into two halves, and each half is learnt from while the other judges. A first classifier
    tells positives from unlabelled, and the class prior is the mean of what its scores give on the judging
    halves. Then the risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]): where its second part
    would fall below zero, the step goes the other way. Such a descent swings, so of its iterates the one of
    lowest risk on the judging half is taken, and that half also sets its scale and zero point. The model is the mean
    of the two.
    """
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1), axis=0).T
    model = Model(edges, np.zeros(edges.shape[0] * BINS + 1), 0.5)
    p, u = model.design(positive), model.design(unlabelled)
    halves = [(p[k::2], u[k::2]) for k in range(2)]
    size = p.shape[1]

    priors = []
    for (own_p, own_u), (p2, u2) in (halves, halves[::-1]):
        apart = lambda w: -own_p.T @ _sigmoid(-(own_p @ w)) / len(own_p) + own_u.T @ _sigmoid(own_u @ w) / len(own_u)  # noqa: B023, E731
        judged = lambda w: np.logaddexp(0, -(p2 @ w)).mean() + np.logaddexp(0, u2 @ w).mean()  # noqa: B023, E731
        first = _descend(size, apart, judged)
        priors.append(class_prior(p2 @ first, u2 @ first))
    model.prior = prior = float(np.mean(priors))

    for (own_p, own_u), (p2, u2) in (halves, halves[::-1]):

        def step(w: np.ndarray) -> np.ndarray:
            fp, fu = own_p @ w, own_u @ w  # noqa: B023
            as_negative = own_u.T @ _sigmoid(fu) / len(fu) - prior * own_p.T @ _sigmoid(fp) / len(fp)  # noqa: B023
            if _risks(prior, fp, fu)[1] < 0:
                return -as_negative
            return as_negative - prior * own_p.T @ _sigmoid(-fp) / len(fp)  # noqa: B023

        own = _descend(size, step, lambda w: _clamped(prior, p2 @ w, u2 @ w))  # noqa: B023
        factor, zero = _scale(prior, p2 @ own, u2 @ own)
        model.weights += factor * own / 2
        model.weights[-1] -= factor * zero / 2
    return model


def train(docs: DataFrame, positives: DataFrame, training: Column) -> Model | None:
    """The model, from at most POSITIVES rows of ``positives`` (doc_id) and UNLABELLED documents.

    Both are the lowest by a hash of doc_id among the rows for which ``training`` holds. None with fewer than
    two positives or two documents to a half. Below some 100 positives the class prior is mostly EXPECTED. The rows
    are of bounded number, so one task fits the model and sends nothing else.
    """
    ids = F.xxhash64("doc_id")
    lowest = lambda df, n: df.where(training & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(ids, "doc_id").limit(n)
    trusted = lowest(positives, POSITIVES).select(F.col("doc_id").alias("_id"), F.lit(True).alias("_positive"))
    chosen = trusted.unionByName(lowest(docs, UNLABELLED).select(F.col("doc_id").alias("_id"), F.lit(False).alias("_positive")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in slices(batch.column("text"), SLICE)]
            rows = pa.array(list(np.concatenate(x)) if x else [], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_positive"), rows], names=["id", "positive", "x"])

    def fitted(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["positive"], r["id"], r["x"]))
        p, u = (np.array([r["x"] for r in rows if r["positive"] is side]) for side in (True, False))
        if min(len(p), len(u)) < 4:
            return pa.table({"edges": pa.array([], pa.list_(pa.float64())), "weights": pa.array([], pa.list_(pa.float64())), "prior": pa.array([], pa.float64())})
        model = fit(p, u)
        return pa.table({"edges": pa.array([model.edges.ravel()], pa.list_(pa.float64())), "weights": pa.array([model.weights], pa.list_(pa.float64())), "prior": [model.prior]})

    found = (
        small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # of a fixed size
        .select("_id", "_positive", "text").mapInArrow(run, "id long, positive boolean, x array<double>")
        .groupBy(F.lit(0).alias("all")).applyInArrow(fitted, "edges array<double>, weights array<double>, prior double").collect()
    )
    return Model(np.array(found[0].edges).reshape(-1, BINS + 1), np.array(found[0].weights), found[0].prior) if found else None


def score(docs: DataFrame, model: Model | None, carried: list[str] = (), name: str = "score") -> DataFrame:
    """doc_id, score (named ``name``) and the columns ``carried`` for every row of ``docs`` (doc_id, text).

    A null text counts as empty, and an empty text is scored like any other; without a model the score is
    0.5. Whole texts are read; repeated rows and null ids are kept. A carried column with the name of the
    result is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(features(t)) if model else np.full(len(t), 0.5) for t in slices(batch.column(0), SLICE)]
            yield with_results(batch, schema.names, pa.array(np.concatenate(found) if found else [], pa.float64()))

    rows, wanted = with_text(docs, carried, (name,))
    schema = result_schema(rows.select(*wanted), **{name: "double"})
    return rows.mapInArrow(run, schema)
