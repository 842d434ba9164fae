"""Severity of toxicity by cumulative-link ordinal regression (operator 7).

Features are the hashed words of a text and their first five bytes (stems), each present or not, so that a labelled document
takes at most one number for each bucket to the driver, whatever its length. One weight vector
serves all thresholds: P(grade >= k) = sigmoid(w x - t_k) with t_1 <= t_2 <= ... . Grades are the distinct values
of the label column in order, so two values give one threshold and more give more. Training is
stochastic in numpy with adaptive steps and a lasso step on a bounded sample of labelled rows.

The result has for each row the expected severity (the sum of P(grade >= k) over thresholds), the probability of any
toxicity, the most likely grade and a flag.

Defined cases: null and empty texts have no features; what the thresholds alone say is returned, and they are never flagged.
Without labelled rows of two grades all severities are 0. Repeated rows are graded alike. Several labels of one
document: the highest counts. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .arrowmap import arrow_map
from .shared import bounded_sample, remainder

_GAP = ~((np.arange(256) >= 128) | ((K.LOWER >= 97) & (K.LOWER <= 122)) | ((np.arange(256) >= 48) & (np.arange(256) <= 57)))
STEM = 5


@dataclass(frozen=True)
class Params:
    """Bound of the sample and settings of the regression."""

    sample: int = 16000
    buckets: int = 1 << 18
    epochs: int = 6
    batch: int = 64
    rate: float = 0.2
    lasso: float = 2e-5
    flag_at: float = 0.5
    seed: int = 3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]


def feature_sets(data: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, each once, in order of text."""
    out = []
    for piece, at, first in K.pieces(data, offsets, split=True):
        starts, ends = K.spans(piece, at, _GAP)
        long = ends - starts > STEM
        heads = K.span_hashes(piece, starts[long], starts[long] + STEM, True, 1)
        ids = np.concatenate([K.span_hashes(piece, starts, ends, True), heads]) & np.uint64(p.buckets - 1)
        owner = np.searchsorted(at, np.concatenate([starts, starts[long]]), side="right") - 1 + first
        out.append(np.unique(owner * p.buckets + ids.astype(np.int64)))
    keys = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return keys // p.buckets, keys % p.buckets


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def learn(sets: list[np.ndarray], grades: np.ndarray, n_grades: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that make the grades (0 .. n_grades - 1) likely."""
    rng = np.random.Generator(np.random.PCG64(p.seed))
    weights, seen = np.zeros(p.buckets), np.full(p.buckets, 1e-3)
    above = np.array([np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, n_grades)])
    thresholds, seen_t = -np.log(above / (1 - above)), np.full(n_grades - 1, 1e-3)
    index = np.arange(n_grades - 1)
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        order = rng.permutation(len(sets))
        for lo in range(0, len(order), p.batch):
            some = order[lo : lo + p.batch]
            ids = np.concatenate([sets[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(sets[i]) for i in some])
            total = np.bincount(owner, weights=weights[ids], minlength=len(some))
            y = grades[some]
            # P(grade = y) = sigmoid(total - t_y) - sigmoid(total - t_{y+1}); its gradient is 1 - a - b.
            a = np.where(y > 0, _sigmoid(total - thresholds[np.maximum(y - 1, 0)]), 1.0)
            b = np.where(y < n_grades - 1, _sigmoid(total - thresholds[np.minimum(y, n_grades - 2)]), 0.0)
            slope = a + b - 1
            touched, inverse = np.unique(ids, return_inverse=True)
            grad = np.bincount(inverse, weights=slope[owner]) / len(some)
            seen[touched] += grad**2
            step = rate / np.sqrt(seen[touched])
            moved = weights[touched] - step * grad
            weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * p.lasso, 0)
            width = np.maximum(a - b, 1e-9)
            grad_t = np.zeros(n_grades - 1)
            np.add.at(grad_t, np.maximum(y - 1, 0), np.where(y > 0, a * (1 - a) / width, 0))
            np.add.at(grad_t, np.minimum(y, n_grades - 2), np.where(y < n_grades - 1, -b * (1 - b) / width, 0))
            grad_t /= len(some)
            seen_t += grad_t**2
            thresholds = np.maximum.accumulate(thresholds - rate * grad_t / np.sqrt(seen_t) + 1e-6 * index)
    return weights, thresholds


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), grade: str = "toxic") -> Model:
    """A model from about ``sample`` labelled rows at most, outside the held-out fold."""
    known = labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).where(remainder() != 0).select("doc_id", F.col(grade).cast("int").alias("grade"))
    known = bounded_sample(known, "doc_id", p.sample).groupBy("doc_id").agg(F.max("grade").alias("grade"))

    def make(batch: pa.RecordBatch) -> dict:
        rows, ids = feature_sets(*K.column(batch.column("text")), p)
        ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        return {"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "ids": pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))}

    got = arrow_map(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), make, "doc_id long, grade int, ids array<int>").toArrow()
    values = got.column("grade").to_numpy()
    names = sorted(set(values.tolist()))
    if len(names) < 2:
        return Model(np.zeros(p.buckets, np.float32), np.zeros(0), names)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    sets = [x.values.to_numpy().astype(np.int64) for x in got.column("ids").combine_chunks().take(pa.array(order))]
    weights, thresholds = learn(sets, np.searchsorted(names, values[order]), len(names), p)
    return Model(weights.astype(np.float32), thresholds, names)


def predict(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, severity, p_toxic, grade and flagged of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        m = sent.value
        rows, ids = feature_sets(*K.column(batch.column("text")), p)
        total = np.bincount(rows, weights=m.weights[ids], minlength=batch.num_rows)
        some = np.bincount(rows, minlength=batch.num_rows) > 0
        if not len(m.thresholds):
            zero = np.zeros(batch.num_rows)
            return {"doc_id": batch.column("doc_id"), "severity": zero, "p_toxic": zero, "grade": np.full(batch.num_rows, m.grades[0] if m.grades else 0), "flagged": zero > 1}
        above = _sigmoid(total[:, None] - m.thresholds[None, :])
        each = np.concatenate([np.ones((len(above), 1)), above], 1) - np.concatenate([above, np.zeros((len(above), 1))], 1)
        return {"doc_id": batch.column("doc_id"), "severity": above.sum(1), "p_toxic": above[:, 0], "grade": np.array(m.grades)[each.argmax(1)], "flagged": some & (above[:, 0] >= p.flag_at)}

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, severity double, p_toxic double, grade int, flagged boolean")
