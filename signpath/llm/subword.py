"""Supervised subword embeddings for document quality (operator 3).

Words and the character n-grams of words, between marks of a word's ends, are hashed into buckets that each have a learnt vector. A document is the mean of the
vectors of all its features; a softmax over two outputs gives the label's probability. Vectors and
output weights are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.

As the output is linear in the mean, the two products of a bucket's vector with the output weights hold all that a
prediction needs, so that scoring adds up table entries over the whole text, whatever its length.

The grams of a word are made once for all its occurrences in some hundred kilobytes of text. A labelled document takes at
most one count for each bucket to the driver, whatever its length; a word of more than ``textkernel.PIECE`` bytes counts as several.

Defined cases: a null or empty text (or one of white space) has no features and gets the probability that the output
bias alone gives. Without labelled rows all scores are 0.5. Repeated rows score alike. An empty table gives an
empty result. Several labels of one document: the lowest counts. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .arrowmap import arrow_map
from .shared import bounded_sample, held_out, remainder


@dataclass(frozen=True)
class Params:
    """Bound of the sample and shape of the model."""

    sample: int = 5000
    buckets: int = 1 << 16
    shortest: int = 3
    longest: int = 5
    dim: int = 8
    epochs: int = 6
    rate: float = 2.0
    seed: int = 5


@dataclass(frozen=True)
class Model:
    #: Logit of label 1 against label 0 that a feature of each bucket adds before the mean is taken.
    logits: np.ndarray
    bias: float


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other between ``<`` and ``>``, and where each begins."""
    sizes = ends - starts + 2
    begin = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    inner = np.ones(len(out), bool)
    inner[begin] = inner[begin + sizes - 1] = False
    out[begin], out[begin + sizes - 1] = ord("<"), ord(">")
    at = np.flatnonzero(inner)
    out[at] = data[at + np.repeat(starts - begin - 1, ends - starts)]
    return out, np.append(begin, len(out))


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of some words and of their character n-grams, and the word of each."""
    text, begin = _marked(data, starts, ends)
    letters = np.flatnonzero((text & 0xC0) != 0x80)  # where characters begin
    first = np.searchsorted(letters, begin)
    edge = np.append(letters, len(text))
    ids, owner = [K.span_hashes(data, starts, ends)], [np.arange(len(starts))]
    last = np.repeat(first[1:], np.diff(first))
    word = np.repeat(np.arange(len(starts)), np.diff(first))
    for size in range(p.shortest, p.longest + 1):
        at = np.flatnonzero(np.arange(len(letters)) + size <= last)
        ids.append(K.span_hashes(text, edge[at], edge[at + size], family=1))
        owner.append(word[at])
    return (np.concatenate(ids) & np.uint64(p.buckets - 1)).astype(np.int64), np.concatenate(owner)


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of distinct words; for every word which of them it is, and its text."""
    starts, ends = K.spans(data, offsets)
    _, first, which = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[first], ends[first], which, np.searchsorted(offsets, starts, side="right") - 1


def learn(ids: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, p: Params) -> Model:
    """Stochastic gradient descent, a document at a time, with a rate that falls to zero."""
    rng = np.random.Generator(np.random.PCG64(p.seed))
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    output, bias = np.zeros((p.dim, 2), np.float32), np.zeros(2, np.float32)
    shares = [(c / c.sum()).astype(np.float32) for c in counts]
    steps, step = p.epochs * len(labels), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(labels)):
            rate = p.rate * (1 - step / steps)
            step += 1
            mean = shares[i] @ vectors[ids[i]]
            logit = mean @ output + bias
            prob = np.exp(logit - logit.max())
            error = prob / prob.sum()
            error[labels[i]] -= 1
            back = output @ error
            output -= (rate * 0.1) * np.outer(mean, error)
            bias -= (rate * 0.01) * error
            # The step is not divided by the text's length, so that rare features of long texts learn too.
            vectors[ids[i]] -= rate * shares[i][:, None] * back * min(len(ids[i]), 100)
    both = vectors @ output
    return Model((both[:, 1] - both[:, 0]).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """A model from about ``sample`` labelled rows at most, all outside the held-out fold."""
    known = labels.where("quality is not null and doc_id is not null").where(remainder() != 0).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = bounded_sample(known, "doc_id", p.sample).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def make(batch: pa.RecordBatch) -> dict:
        data, offsets = K.column(batch.column("text"))
        ids, counts = [], []
        for i in range(batch.num_rows):
            total = np.zeros(p.buckets, np.int64)
            for piece, at, _ in K.pieces(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), split=True):
                starts, ends, which, _ = distinct_words(piece, at)
                found, owner = word_features(piece, starts, ends, p)
                total += np.bincount(found, weights=np.bincount(which, minlength=len(starts))[owner], minlength=p.buckets).astype(np.int64)
            ids.append(np.flatnonzero(total).astype(np.int32))
            counts.append(total[ids[-1]].astype(np.int32))
        return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "ids": pa.array(ids, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32()))}

    got = arrow_map(some, make, "doc_id long, quality int, ids array<int>, counts array<int>").where("size(ids) > 0").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    arrays = lambda name: [x.values.to_numpy() for x in got.column(name).combine_chunks().take(pa.array(order))]
    if not len(order):
        return Model(np.zeros(p.buckets, np.float32), 0.0)
    return learn(arrays("ids"), arrays("counts"), (got.column("quality").to_numpy()[order] == 1).astype(int), p)


def score_texts(data: np.ndarray, offsets: np.ndarray, model: Model, p: Params) -> np.ndarray:
    """Probability of label 1 of each text."""
    n = len(offsets) - 1
    total, seen = np.zeros(n), np.zeros(n)
    for piece, at, first in K.pieces(data, offsets, split=True):
        starts, ends, which, text = distinct_words(piece, at)
        ids, owner = word_features(piece, starts, ends, p)
        logit, count = np.bincount(owner, weights=model.logits[ids], minlength=len(starts)), np.bincount(owner, minlength=len(starts))
        size = len(at) - 1
        total[first : first + size] += np.bincount(text, weights=logit[which], minlength=size)
        seen[first : first + size] += np.bincount(text, weights=count[which], minlength=size)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(seen, 1) + model.bias, -50, 50)))


def predict(docs: DataFrame, model: Model, p: Params = Params(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        score = score_texts(*K.column(batch.column("text")), sent.value, p)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return arrow_map(docs.select("doc_id", held_out().alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double, predicted int")
