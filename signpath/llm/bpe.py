"""BPE encoding and decoding by tree concatenation (operator 10).

A vocabulary file of the tokenizers library gives the results to match. A text longer than ``segment`` characters is cut into
segments, halving it again and again; the segments are encoded in parallel, each in a row of its own, and then
joined in pairs up the same tree. At a join the text around the cut is encoded anew, in a window that
doubles until its tokens agree with those of the left side and of the right side, in identifier and place, on
two tokens in a row that are ``GUARD`` characters away from the cut. Left tokens up to there, window tokens, and right tokens
from there on are the encoding of the whole: each pair of neighbours stands so in an encoding made by the library, and
BPE merges never look beyond neighbours. If a window reaches both ends it is the whole text itself. Unsplit stretches
(without white space) longer than ``leaf`` are halved down to ``leaf`` and joined by the same tree inside a task.

With a vocabulary that drops white space, as ``word_bpe_49k.json`` does, no token depends on anything beyond its stretch
of non-white characters, so that texts of at most ``segment`` bytes are encoded stretch by stretch, each distinct one once
for some megabytes of text (equal hashes are confirmed by the bytes), with a memory of recent ones that is bounded in
bytes and ends with the task.

Defined cases: null and empty texts, and those of white space alone, have no tokens: the digests are those of the empty
string. Strings of special tokens inside a text become those tokens, as in the library. Repeated rows are encoded each
by itself. An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .arrowmap import arrow_map, trimmed
from .shared import stored

GUARD = 32
FIRST_WINDOW = 128


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Params:
    """Vocabulary file, longest segment of a text and longest leaf of an unsplit stretch in characters, the bytes that a task remembers, and the bytes of texts whose distinct stretches are found together."""

    vocabulary: str = ""
    segment: int = 32768
    leaf: int = 4096
    memory: int = 128 << 20
    together: int = 8 << 20
    #: Whether the tokenizer itself, some 30 MB, stays in the process for the next task.
    keep: bool = True


#: About what Python needs for a remembered stretch besides its strings.
OVERHEAD = 200
#: Long texts or segments that a task turns to tokens before it hands them on.
LONG_ROWS = 16


@dataclass
class Encoded:
    """Tokens of a text, with the characters [start, end) of each."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def moved(self, by: int) -> Encoded:
        return Encoded(self.ids, self.starts + by, self.ends + by)


class Encoder:
    """The library's tokenizer with tree concatenation for long texts and a memory for short stretches."""

    def __init__(self, p: Params):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.p = p
        path = p.vocabulary or default_vocabulary()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.loads(f.read().split('"model":')[0].rstrip().rstrip(",") + "}")  # what stands before the vocabulary
        #: Whether white space only divides: its tokens are dropped and decoding puts blanks between tokens.
        self.divides = told.get("decoder") is None and "\\s\\p{L}\\p{N}" in json.dumps(told.get("pre_tokenizer")).replace("\\\\", "\\") and '"Removed"' in json.dumps(told.get("pre_tokenizer"))
        if self.divides:
            vocabulary = self.tok.get_vocab(with_added_tokens=True)
            size = max(vocabulary.values(), default=-1) + 1
            #: What is written for each identifier, and what it decodes to, each with the blank that divides it from the next.
            self.numbers = pa.array([f"{i} " for i in range(size)], pa.large_string())
            self.names = pa.array([f"{self.tok.id_to_token(i)} " for i in range(size)], pa.large_string())
        self.forget()

    def forget(self) -> None:
        #: Stretch to identifiers; the older half goes first when full.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def library(self, text: str) -> Encoded:
        e = self.tok.encode(text, add_special_tokens=False)
        starts, ends = _places(e.offsets)
        return Encoded(np.array(e.ids, np.int32), starts.astype(np.int32), ends.astype(np.int32))

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)

    def tree(self, text: str, segment: int | None = None) -> Encoded:
        """The encoding of ``text`` by halves down to ``segment`` characters."""
        parts = [self.library(text[a:b]).moved(a) for a, b in cuts(text, segment or self.p.segment)]
        return self.joined(text, parts, cuts(text, segment or self.p.segment))

    def joined(self, text: str, parts: list[Encoded], at: list[tuple[int, int]]) -> Encoded:
        """Join the encodings of neighbouring pieces [a, b) of ``text`` in pairs until one is left."""
        while len(parts) > 1:
            pairs, spans = [], []
            for i in range(0, len(parts) - 1, 2):
                pairs.append(self.join(text, parts[i], parts[i + 1], at[i][0], at[i][1], at[i + 1][1]))
                spans.append((at[i][0], at[i + 1][1]))
            if len(parts) % 2:
                pairs.append(parts[-1])
                spans.append(at[-1])
            parts, at = pairs, spans
        return parts[0] if parts else Encoded(*[np.zeros(0, np.int32)] * 3)

    def join(self, text: str, left: Encoded, right: Encoded, a: int, cut: int, b: int) -> Encoded:
        width = FIRST_WINDOW
        while True:
            lo, hi = a, b
            if cut - width > a and len(left.ids):
                lo = int(left.starts[max(0, np.searchsorted(left.starts, cut - width, side="right") - 1)])
            if cut + width < b and len(right.ids):
                hi = int(right.ends[min(len(right.ids) - 1, np.searchsorted(right.ends, cut + width))])
            lo, hi = (lo if lo < cut else a), (hi if hi > cut else b)
            mid = self.library(text[lo:hi]).moved(lo)
            head = (0, 0) if lo == a else _agreed(left, mid, None, cut - GUARD)
            tail = (len(mid.ids), len(right.ids)) if hi == b else _agreed(mid, right, cut + GUARD, None)
            if head and tail and head[1] <= tail[0]:
                pick = lambda name: np.concatenate([getattr(left, name)[: head[0]], getattr(mid, name)[head[1] : tail[0]], getattr(right, name)[tail[1] :]])  # noqa: B023, E731
                return Encoded(pick("ids"), pick("starts"), pick("ends"))
            width *= 2

    def stretches(self, words: list[str]) -> list[bytes]:
        """Identifiers of each of many stretches without white space, as bytes of 32-bit numbers, from one call on all of them."""
        text, sizes = " ".join(words), np.array([len(w) + 1 for w in words], np.int64)
        begin = np.cumsum(sizes) - sizes
        e = self.tok.encode(text, add_special_tokens=False)
        starts, ends = _places(e.offsets)
        owner = np.searchsorted(begin, starts, side="right") - 1
        if (owner != np.searchsorted(begin, ends - 1, side="right") - 1).any() or (np.diff(owner) < 0).any():
            return [np.array(x.ids, np.int32).tobytes() for x in self.tok.encode_batch(words, add_special_tokens=False)]
        ids, at = np.array(e.ids, np.int32).tobytes(), (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def known(self, words: list[bytes], often: list[bool]) -> list[bytes]:
        """Identifiers of distinct stretches, as bytes of 32-bit numbers; of new ones only those seen ``often`` are remembered."""
        out, old = list(map(self.young.get, words)), self.old
        missing = [i for i, got in enumerate(out) if got is None]
        if old:
            for i in missing:
                got = out[i] = old.get(words[i])
                if got is not None:
                    self._remember(words[i], got)
            missing = [i for i in missing if out[i] is None]
        for lo in range(0, len(missing), 8192):
            some = missing[lo : lo + 8192]
            texts = [words[i].decode("utf-8", "replace") for i in some]
            found = iter(self.stretches([x for x in texts if len(x) <= self.p.leaf]))
            for i, x in zip(some, texts, strict=True):
                out[i] = next(found) if len(x) <= self.p.leaf else self.tree(x, self.p.leaf).ids.astype(np.int32).tobytes()
                if often[i]:
                    self._remember(words[i], out[i])
        return out

    def _remember(self, word: bytes, got: bytes) -> None:
        size = len(word) + len(got) + OVERHEAD
        if size > self.p.memory // 8:
            return
        if self.size + size > self.p.memory // 2:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[word] = got
        self.size += size

    def told(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes | np.ndarray, bytes | np.ndarray]]:
        """Number of tokens, identifiers joined by blanks, and the decoded text of each text, the latter two in UTF-8.

        Stretches are found and hashed in numpy over many texts, so that Python handles each distinct one once.
        """
        if not self.divides:
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                yield self.spelled(self.tree(data[a:b].tobytes().decode(), self.p.segment))
            return
        for lo, hi in K.groups(offsets, self.p.together):
            yield from self._told(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    def spelled(self, e: Encoded) -> tuple[int, bytes, bytes]:
        """As ``told`` gives it."""
        ids = e.ids.tolist()
        return len(ids), " ".join(map(str, ids)).encode(), self.decode(ids).encode()

    def _told(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        starts, ends = K.spans(data, offsets)
        _, first, place = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        for i in np.flatnonzero(~K.same_spans(data, starts, ends, starts[first[place]], ends[first[place]])):  # a hash of two stretches
            place[i] = len(first)
            first = np.append(first, i)
        raw = data.tobytes()
        got = self.known([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], (np.bincount(place, minlength=len(first)) > 1).tolist())
        sizes = np.array([len(x) // 4 for x in got], np.int64)
        counts = sizes[place]
        upto = np.concatenate([[0], np.cumsum(counts)])
        begin = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(got), np.int32)[np.arange(upto[-1]) + np.repeat(begin[place] - upto[:-1], counts)]
        at = upto[np.searchsorted(starts, offsets)]
        yield from zip(np.diff(at).tolist(), _lines(self.numbers, ids, at), _lines(self.names, ids, at), strict=True)


def _places(offsets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    spans = np.fromiter(itertools.chain.from_iterable(offsets), np.int64, 2 * len(offsets)).reshape(-1, 2)
    return spans[:, 0], spans[:, 1]


def _lines(words: pa.Array, ids: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each range between neighbouring ``at`` the words of its identifiers, which end in a blank, without the last blank, in UTF-8."""
    data, edges = K.column(words.take(pa.array(ids)))
    edges = edges[at].tolist()
    return (data[a : max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:], strict=True))


def _agreed(one: Encoded, two: Encoded, least: int | None, most: int | None) -> tuple[int, int] | None:
    """Places in both where two tokens in a row are the same, begin at ``least`` or end by ``most``, at the edge of a character."""
    lo, hi = (two.starts[0] if len(two.starts) else 0), (one.ends[-1] if len(one.ends) else 0)
    i0, i1 = np.searchsorted(one.starts, lo), len(one.ids)
    j0, j1 = 0, int(np.searchsorted(two.ends, hi, side="right"))
    place = {}
    for i in range(int(i0), i1 - 1):
        if (least is None or one.starts[i] >= least) and (most is None or one.ends[i + 1] <= most) and (i == 0 or one.starts[i] >= one.ends[i - 1]):
            place[(one.ids[i], one.starts[i], one.ends[i], one.ids[i + 1], one.starts[i + 1], one.ends[i + 1])] = i
    found = None
    for j in range(j0, j1 - 1):
        if j == 0 or two.starts[j] >= two.ends[j - 1]:
            i = place.get((two.ids[j], two.starts[j], two.ends[j], two.ids[j + 1], two.starts[j + 1], two.ends[j + 1]))
            if i is not None:
                found = (i, j)
                if least is not None:
                    return found
    return found


def _safe(text: str, at: int) -> bool:
    """Whether normalisation of both sides of a cut is that of the whole."""
    if text[at] < "\x80":
        return True
    a, b = text[max(0, at - 16) : at], text[at : at + 16]
    n = lambda x: unicodedata.normalize("NFC", x)
    return not unicodedata.combining(text[at]) and n(a + b) == n(a) + n(b)


def cuts(text: str, segment: int) -> list[tuple[int, int]]:
    """Pieces of at most about ``segment`` characters by repeated halving, none cut inside a composed character."""

    def halve(a: int, b: int) -> Iterator[tuple[int, int]]:
        if b - a <= segment:
            yield (a, b)
            return
        at = (a + b) // 2
        while at < b and not _safe(text, at):
            at += 1
        if at >= b:
            yield (a, b)
            return
        yield from halve(a, at)
        yield from halve(at, b)

    return list(halve(0, len(text))) if text else []


_encoders: dict[Params, Encoder] = {}


def encoder(p: Params) -> Encoder:
    """One encoder for each process or task."""
    if p not in _encoders:
        _encoders[p] = Encoder(p)
    return _encoders[p]


def _forget() -> None:
    """Drop what was remembered, and encoders that aren't kept, at a task's end: other stages run in the same processes."""
    for p, e in list(_encoders.items()):
        e.forget()
        if not p.keep:
            del _encoders[p]


def _digest(n: int, ids: bytes | np.ndarray, text: bytes | np.ndarray) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_tokens and the digests of identifiers and decoded text of every row."""

    def leaves(batch: pa.RecordBatch) -> dict:
        got = [_digest(*x) for x in encoder(p).told(*K.column(batch.column("text")))]
        return dict(zip(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), [batch.column("doc_id"), *([list(x) for x in zip(*got, strict=True)] or [[], [], []])], strict=True))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over the segments sorted by text: one text is held at a time."""
        with trimmed(_forget):
            for rows in _runs(batches):
                e = encoder(p)
                n, a, b = _digest(*e.spelled(_assembled(rows, e)[1]))
                values = [rows.column("doc_id").slice(0, 1).combine_chunks(), pa.array([n]), pa.array([a]), pa.array([b])]
                yield pa.RecordBatch.from_arrays(values, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    short = arrow_map(rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= p.segment), leaves, RESULT, _forget)
    parts = encoded_segments(rows.where(F.octet_length("text") > p.segment), p)
    return short.unionByName(parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(finish, RESULT))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one key after the other, of batches sorted by it."""
    rest: list[pa.Table] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if rest and rest[0].column("key")[0].as_py() != keys[a]:
                yield pa.concat_tables(rest)
                rest = []
            rest.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if rest:
        yield pa.concat_tables(rest)


def encoded_segments(long: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (key, doc_id, part, text, ids, starts, ends) of long texts' segments, encoded in parallel."""

    def split(batch: pa.RecordBatch) -> dict | None:
        out = []
        for key, doc, text in zip(*[batch.column(c).to_pylist() for c in ("key", "doc_id", "text")], strict=True):
            out += [(key, doc, k, text[a:b]) for k, (a, b) in enumerate(cuts(text, p.segment))]
        return dict(zip(("key", "doc_id", "part", "text"), [list(x) for x in zip(*out, strict=True)], strict=True)) if out else None

    def encode(batch: pa.RecordBatch) -> dict:
        e = [encoder(p).library(x) for x in batch.column("text").to_pylist()]
        return {c: batch.column(c) for c in ("key", "doc_id", "part", "text")} | {n: pa.array([getattr(x, n) for x in e], pa.list_(pa.int32())) for n in ("ids", "starts", "ends")}

    keyed = stored(long.withColumn("key", F.monotonically_increasing_id()), "long-texts")
    pieces = arrow_map(keyed, split, "key long, doc_id long, part int, text string", rows=LONG_ROWS)
    return arrow_map(pieces.repartition("key", "part"), encode, "key long, doc_id long, part int, text string, ids array<int>, starts array<int>, ends array<int>", _forget, LONG_ROWS)


def _assembled(rows: pa.Table, e: Encoder) -> tuple[str, Encoded]:
    rows = rows.sort_by("part").combine_chunks()
    texts = rows.column("text").to_pylist()
    ends = np.cumsum([len(x) for x in texts])
    at = [(int(b) - len(x), int(b)) for x, b in zip(texts, ends, strict=True)]
    flat = lambda n, i: rows.column(n)[i].values.to_numpy()
    parts = [Encoded(*[flat(n, i) for n in ("ids", "starts", "ends")]).moved(a) for i, (a, _) in enumerate(at)]
    text = "".join(texts)
    return text, e.joined(text, parts, at)
