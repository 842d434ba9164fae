"""Language mixtures of documents (operator 1).

Each language is a distribution over hashed byte trigrams of words. A document is a mixture of languages; its
proportions are estimated by expectation-maximisation over its distinct trigrams. The set of languages is chosen by
penalised likelihood: from all of them, the least is removed as long as the likelihood falls by less
than the penalty for one language. The prediction is the language of the largest share.

Defined cases: null texts and texts without a letter are ``und`` with score 0. So is every text if nothing
could be learnt (no labelled rows). Equal shares go to the language that comes first in the alphabet. Repeated rows
are predicted alike. An empty table gives an empty result. Other columns are ignored.
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

GRAMS = 1 << 16
#: ASCII letters in lower case; bytes of other letters as they are; all else is a space.
_LETTERS = np.where((np.arange(256) >= 128) | ((K.LOWER >= 97) & (K.LOWER <= 122)), K.LOWER, 32).astype(np.uint8)


@dataclass(frozen=True)
class Params:
    """Bounds and penalties."""

    sample: int = 20000
    smoothing: float = 0.05
    rounds: int = 10
    refine: int = 6
    #: Price of a language: so many times the logarithm of the number of trigrams, plus a share of that number.
    per_log: float = 2.0
    per_gram: float = 0.01


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray


def gram_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around every letter byte, and the text of each."""
    b = _LETTERS[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero((b[1:-1] != 32) & ~edge[1:-2] & ~edge[2:-1])
    return ((codes[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), np.searchsorted(offsets, at, side="right") - 1


def sparse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) of the distinct trigrams of each text, in order of text."""
    rows, grams, counts = [], [], []
    for lo, hi in K.groups(offsets, 2 * K.PIECE):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if hi == lo + 1 and len(part) > 2 * K.PIECE:
            all_of = sum(np.bincount(gram_ids(piece, cut)[0], minlength=GRAMS) for piece, cut, _ in K.pieces(part, at, split=True))
            g = np.flatnonzero(all_of)
            r, n = np.full(len(g), lo), all_of[g]
        else:
            g, owner = gram_ids(part, at)
            keys = np.sort(owner * GRAMS + g)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(keys)))
            r, g = keys[first] // GRAMS + lo, keys[first] % GRAMS
        rows.append(r), grams.append(g), counts.append(n)
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return join(rows), join(grams), join(counts)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def mixtures(rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, n: int, model: Model, p: Params) -> np.ndarray:
    """Shares of the languages in each of n texts; all zero for a text without trigrams."""
    out = np.zeros((n, len(model.langs)))
    if not len(rows) or not model.langs:
        return out
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    docs, sizes = rows[starts], np.diff(np.append(starts, len(rows)))
    weight, like = counts.astype(np.float32), model.table[grams]
    total = _sums(weight, starts)
    price = p.per_log * np.log(total + 1) + p.per_gram * total

    def climb(shares, like, weight, starts, sizes, total, rounds):
        for _ in range(rounds):
            joint = np.repeat(shares, sizes, axis=0) * like
            joint *= (weight / joint.sum(1))[:, None]
            shares = (_sums(joint, starts) / total[:, None]).astype(np.float32)
        mixed = (np.repeat(shares, sizes, axis=0) * like).sum(1)
        return shares, _sums(weight * np.log(mixed), starts)

    alone = _sums(weight[:, None] * np.log(like), starts)
    start = np.full((len(docs), len(model.langs)), 1 / len(model.langs), np.float32)
    shares, best = climb(start, like, weight, starts, sizes, total, p.rounds)
    one = alone.max(1) >= best - price
    final = np.where(one[:, None], np.eye(len(model.langs))[alone.argmax(1)], shares)
    open_ = np.flatnonzero(~one)
    while len(open_):
        active = final[open_] > 0
        some = active.sum(1) > 1
        open_ = open_[some]
        if not len(open_):
            break
        least = np.where(final[open_] > 0, final[open_], np.inf).argmin(1)
        less = final[open_].astype(np.float32)
        less[np.arange(len(open_)), least] = 0
        less /= np.maximum(less.sum(1, keepdims=True), 1e-30)
        at = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in open_])
        cut = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
        less, reached = climb(less, like[at], weight[at], cut, sizes[open_], total[open_], p.refine)
        fewer = reached >= best[open_] - price[open_]
        final[open_[fewer]], best[open_[fewer]] = less[fewer], reached[fewer]
        open_ = open_[fewer]
    # Shares as found under the chosen set; for a single language the share that the full mixture gives it is its certainty.
    out[docs] = final
    out[docs[one]] = np.where(np.eye(len(model.langs), dtype=bool)[alone.argmax(1)][one], np.maximum(shares[one], 0.5), 0)
    return out


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    """Trigram distributions from about ``sample`` documents at most, with a known language and outside the held-out fold."""
    known = docs.where("lang is not null and text is not null").where(remainder() != 0).select("doc_id", "lang", "text")
    some = bounded_sample(known, "doc_id", p.sample).repartition(8)

    def make(batch: pa.RecordBatch) -> dict | None:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        index = np.array([names.index(x) for x in langs], np.int64)
        rows, grams, counts = sparse(*K.column(batch.column("text")))
        if not len(rows):
            return None
        sums = np.bincount(index[rows] * GRAMS + grams, weights=counts, minlength=len(names) * GRAMS)
        at = np.flatnonzero(sums)
        return {"lang": [names[i] for i in at // GRAMS], "gram": at % GRAMS, "n": sums[at].astype(np.int64)}

    found = arrow_map(some, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((GRAMS, max(len(langs), 1)))
    index = {x: i for i, x in enumerate(langs)}
    counts[found.column("gram").to_numpy(), [index[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    seen = max(int((counts.sum(1) > 0).sum()), 1)
    table = (counts + p.smoothing) / (counts.sum(0) + p.smoothing * seen)
    return Model(langs, np.ascontiguousarray((table / table.max(1, keepdims=True)).astype(np.float32)) if langs else np.zeros((GRAMS, 0), np.float32))


def predict(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the shares of all languages found, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        m, text = sent.value, batch.column("text")
        data, offsets = K.column(text)
        shares = np.zeros((batch.num_rows, len(m.langs)))
        for lo, hi in K.groups(offsets, 2 * K.PIECE):
            shares[lo:hi] = mixtures(*sparse(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), hi - lo, m, p)
        lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
        known = lettered & bool(m.langs)
        if m.langs:
            shares[lettered & (shares.sum(1) == 0), 0] = 1 / len(m.langs)
        best = shares.argmax(1) if m.langs else np.zeros(batch.num_rows, np.int64)
        return {
            "doc_id": batch.column("doc_id"),
            "held_out": batch.column("held_out"),
            "lang_pred": [m.langs[i] if k else "und" for i, k in zip(best, known, strict=True)],
            "score": np.where(known, np.minimum(shares.max(1, initial=0), 1), 0.0),
            "mixture": [[(m.langs[i], float(x[i])) for i in np.flatnonzero(x > 0)] if k else [] for x, k in zip(shares, known, strict=True)],
        }

    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), "text")
    return arrow_map(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, mixture map<string, double>")
