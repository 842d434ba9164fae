"""Quality rules with an isolation forest over rule statistics (operator 6).

``rule_statistics`` counts, in one vectorised pass over the bytes of each whole text, what the rules need.
``fit`` grows random isolation trees, each from its own rows drawn from all documents outside the held-out fold, and sets
the anomaly threshold from all labelled rows outside it. ``judge`` adds both verdicts to every document.

Defined cases: a null, empty or white text has no words and fails the base rule. A null doc_id is scored like any other.
Repeated rows are judged each by itself. An empty table gives an empty result. Without labelled rows of
both kinds nothing is rejected but by the base rule. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpath.shipping import ship

from . import textkernel as K
from .arrowmap import BATCH_ROWS, arrow_map, bound_batches, trimmed
from .shared import remainder, stored

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 5


@dataclass(frozen=True)
class Params:
    """The shape of the forest, and how many scores are sorted at once."""

    trees: int = 128
    tree_rows: int = 256
    max_false_reject: float = 0.004
    seed: int = 11
    sorted_scores: int = 65536


@dataclass(frozen=True)
class Model:
    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    depth: int
    norm: float
    threshold: float


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, of each text. Equal hashes are confirmed by the bytes."""
    n = len(offsets) - 1
    if n == 1 and len(data) > K.PIECE:
        return _dup_lines_of_long(data)
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[np.maximum(ends - 1, 0)] == 10) if len(starts) else ends[:0]
    filled = np.concatenate([[0], np.cumsum(~K.WHITE[data])])
    keep = filled[ends] > filled[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    keys = K.mix(K.span_hashes(data, starts, ends) + owner.astype(np.uint64) * K.PLACES[9])
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1]) + 1
    one, two = order[same - 1], order[same]
    real = (owner[one] == owner[two]) & K.same_spans(data, starts[one], ends[one], starts[two], ends[two])
    dups = np.bincount(owner[two[real]], minlength=n)
    for text in np.unique(owner[np.concatenate([one[~real], two[~real]])]):  # a hash of two lines
        lines = [data[i:j].tobytes() for i, j in zip(starts[owner == text], ends[owner == text], strict=True)]
        dups[text] = len(lines) - len(set(lines))
    return np.bincount(owner, minlength=n), dups


def _dup_lines_of_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long text, a line after the other; no more than its distinct lines is held."""
    lines, seen = 0, set()
    for line in io.BytesIO(memoryview(np.ascontiguousarray(data))):
        if line.strip(b" \t\r\n\x0b\x0c"):
            lines += 1
            seen.add(line.removesuffix(b"\n"))
    return np.array([lines]), np.array([lines - len(seen)])


def _repeated(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words in windows of five found twice or more in the same text."""
    grams, starts = K.windows(words, at, WINDOW)
    if len(at) == 2:
        keys, owner = grams, np.zeros(1, np.int64)
    else:
        owner = np.repeat(np.arange(len(at) - 1), np.diff(starts))
        keys = K.mix(grams + owner.astype(np.uint64) * K.PLACES[9])
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(at) - 1, np.int64)
    near = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = np.flatnonzero(twice[near] == keys)
    first = hit if len(at) == 2 else hit - starts[owner[hit]] + at[owner[hit]]
    mark = np.zeros(len(words) + WINDOW, bool)
    for k in range(WINDOW):
        mark[first + k] = True
    return K.totals(mark[: len(words)], at)


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts and the further features of each text of a byte buffer."""
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in COUNTS} | {"features": np.zeros((n, 8))}
    for lo, hi in K.groups(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        words, ends = K.word_hashes(part, at)
        n_words = np.diff(ends)
        tally = {name: np.zeros(hi - lo, np.int64) for name in ("chars", "symbols", "upper", "digit", "punct")}
        for piece, cut, first in K.slabs(part, at):
            to = slice(first, first + len(cut) - 1)
            tally["chars"][to] += K.totals(~K.WHITE[piece] & ((piece & 0xC0) != 0x80), cut)
            for name, flags in (("symbols", SYMBOL), ("upper", _UPPER), ("digit", _DIGIT), ("punct", _PUNCT)):
                tally[name][to] += K.totals(flags[piece], cut)
        lines, dups = _dup_lines(part, at)
        repeated = _repeated(words, ends)
        for k, v in zip(COUNTS, (n_words, tally["chars"], tally["symbols"], dups, repeated), strict=True):
            out[k][lo:hi] = v
        chars, some = np.maximum(tally["chars"], 1), np.maximum(n_words, 1)
        out["features"][lo:hi] = np.stack([np.log1p(n_words), chars / some, tally["symbols"] / some, dups / np.maximum(lines, 1), repeated / some, tally["upper"] / chars, tally["digit"] / chars, tally["punct"] / chars], 1)
    return out


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts and the feature vector of every whole text."""

    def make(batch: pa.RecordBatch) -> dict:
        got = statistics_of(*K.column(batch.column("text")))
        features = got.pop("features")
        flat = pa.ListArray.from_arrays(np.arange(0, features.size + 1, 8, dtype=np.int32), pa.array(features.ravel()))
        return {"doc_id": batch.column("doc_id"), **got, "features": flat}

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", features array<double>")


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(rows: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Trees as complete binary arrays: feature and split value of inner nodes, path length of the leaves.

    Trees take ``tree_rows`` rows each and no row twice while there are enough of them; else each draws from all rows.
    """
    rng = np.random.Generator(np.random.PCG64(p.seed))
    size = min(p.tree_rows, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    feature = np.zeros((p.trees, 2**depth - 1), np.int64)
    split = np.full((p.trees, 2**depth - 1), np.inf)
    length = np.zeros((p.trees, 2**depth))

    def node(t: int, at: int, level: int, some: np.ndarray) -> None:
        spread = some.max(0) - some.min(0) if len(some) else np.zeros(rows.shape[1])
        if level == depth or len(some) <= 1 or not (spread > 0).any():
            width = 2 ** (depth - level)
            first = (at + 1) * width - 2**depth
            length[t, first : first + width] = level + _average_path(len(some))
            return
        f = int(rng.choice(np.flatnonzero(spread > 0)))
        v = rng.uniform(some[:, f].min(), some[:, f].max())
        feature[t, at], split[t, at] = f, v
        right = some[:, f] >= v
        node(t, 2 * at + 1, level + 1, some[~right])
        node(t, 2 * at + 2, level + 1, some[right])

    dealt = rng.permutation(len(rows)) if len(rows) >= p.trees * size else None
    for t in range(p.trees):
        node(t, 0, 0, rows[rng.choice(len(rows), size, replace=False) if dealt is None else dealt[t * size : (t + 1) * size]])
    return feature, split, length, depth


def anomaly(model: Model, rows: np.ndarray) -> np.ndarray:
    """Isolation score in (0, 1]; larger is more anomalous."""
    total = np.zeros(len(rows))
    each = np.arange(len(rows))
    for t in range(len(model.feature)):
        at = np.zeros(len(rows), np.int64)
        for _ in range(model.depth):
            at = 2 * at + 1 + (rows[each, model.feature[t][at]] >= model.split[t][at])
        total += model.length[t][at - 2**model.depth + 1]
    return 2.0 ** (-total / len(model.feature) / model.norm)


def _by_id(row) -> tuple:
    """Rows in an order that doesn't depend on how they were read; those of the trees are few enough to sort here."""
    return (row.doc_id is None, row.doc_id or 0, tuple(row.features))


def _drawn(docs: DataFrame, p: Params) -> DataFrame:
    """The rows of all trees, drawn by a hash of doc_id from all rows of ``docs``: somewhat more than the trees take, or all where there are no more."""
    total, wanted = docs.count(), p.trees * p.tree_rows
    share = int(min(1.25 * wanted / max(total, 1), 1) * (1 << 30))
    return docs.where(F.pmod(F.xxhash64(F.lit(p.seed), F.col("doc_id").cast("string")), F.lit(1 << 30)) < share)


def ranked_score(scores: DataFrame, place: int, most: int) -> float:
    """The score at ``place``, counted from 0 and from the largest: exact, by counts of ever smaller ranges until ``most`` rows can be sorted."""
    n, lo, hi = scores.agg(F.count("*"), F.min("score"), F.max("score")).first()
    while n > most and lo < hi:
        bins = 1024
        at = F.least(F.floor((F.col("score") - lo) / (hi - lo) * bins), F.lit(bins - 1))
        inside = scores.where(F.col("score").between(lo, hi)).groupBy(at.alias("bin"))
        for row in sorted(inside.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect(), key=lambda r: -r.bin):
            if place < row.n:
                n, lo, hi = row.n, row.lo, row.hi
                break
            place -= row.n
    if lo == hi:
        return lo
    return sorted((r.score for r in scores.where(F.col("score").between(lo, hi)).collect()), reverse=True)[place]


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model | None:
    """A forest whose trees draw from all documents outside the held-out fold, and a threshold from all labelled ones outside it."""
    learnt = docs.select("doc_id", "text").where(F.coalesce(remainder() != 0, F.lit(True)))
    got = rule_statistics(_drawn(learnt, p)).where("n_words > 0").collect()
    rows = np.array([x.features for x in sorted(got, key=_by_id)]).reshape(-1, 8)
    if not len(rows):
        return None
    model = Model(*grow(rows, p), max(_average_path(min(p.tree_rows, len(rows))), 1e-9), np.inf)
    known = labels.where("quality is not null and doc_id is not null").where(remainder() != 0).select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # All texts of these folds are scored where they are read, so that none goes through a shuffle to meet its label.
    judged = judge(docs.where(remainder() != 0), model).where("not base_failed").join(known, "doc_id").select((F.col("quality") == 1).alias("good"), F.col("anomaly").alias("score"))
    judged = stored(judged, "labelled-scores")
    good, bad = judged.where("good").select("score"), judged.where("not good").select("score")
    n_good, n_bad = judged.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not n_good or not n_bad:
        return model
    # The lowest threshold at which not more than the given share of good rows is rejected.
    floor = ranked_score(good, min(int(p.max_false_reject * n_good), n_good - 1), p.sorted_scores)
    worse = bad.where(F.col("score") > floor).agg(F.min("score")).first()[0]
    threshold = np.inf if worse is None else (floor + worse) / 2
    return Model(model.feature, model.split, model.length, model.depth, model.norm, float(threshold))


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the anomaly score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        got = statistics_of(*K.column(batch.column("text")))
        features, m = got.pop("features"), sent.value
        failed = base_failed(got["n_words"], got["n_repeat_words"])
        score = anomaly(m, features) if m is not None else np.zeros(len(features))
        return {"doc_id": batch.column("doc_id"), **got, "base_failed": failed, "kept": ~failed & (score <= (m.threshold if m else np.inf)), "anomaly": score}

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")


def keep(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is kept.

    The verdict depends on the text alone, so it is computed beside each row, without a join.
    """
    model = fit(docs, labels, p)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # Columns go by number, as names with dots can't be passed to Python.
    rows, text = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns.index("text")
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)

    def run(batches):
        with trimmed():
            for whole in batches:
                for lo in range(0, whole.num_rows, BATCH_ROWS):
                    batch = whole.slice(lo, BATCH_ROWS)
                    got = statistics_of(*K.column(batch.column(text)))
                    m, failed = sent.value, base_failed(got["n_words"], got["n_repeat_words"])
                    good = ~failed & (anomaly(m, got["features"]) <= m.threshold if m is not None else True)
                    yield batch.filter(pa.array(good))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
