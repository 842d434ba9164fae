"""Vectorised work on the bytes of many texts at once: words, their hashes, lines, n-grams.

An Arrow string column is one byte buffer with offsets, so that words of thousands of documents can be
found and hashed in a few numpy calls, with no Python object for a word or even a text. Words are maximal runs
of bytes other than ASCII white space (space, \\t to \\r), which equals ``[^\\x20\\x09-\\x0D]+`` on code points.

Hashes of spans add up mixed eight-byte blocks, each with a constant of its place. The blocks of all spans are taken side by
side, those of a long span one after another in slices, so that memory is bounded by the piece size whatever the length
of a text or of a single word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Multipliers of the words of a window, first to fifth, and so on; the second half is for the second family.
PLACES = _rng.integers(1, 2**64, 128, dtype=np.uint64) | np.uint64(1)
#: Keeps the first 0 to 8 bytes of a block.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more blocks than this are hashed one by one.
_SIDE_BY_SIDE = 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _keys(first: int, last: int, family: int) -> np.ndarray:
    """Constants of the block places first .. last - 1."""
    return mix((np.arange(first + 1, last + 1).astype(np.uint64) + np.uint64(family << 40)) * _STEP)


def _blocks(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian blocks, with at least two blocks of zeros behind them."""
    padded = np.zeros(len(data) // 8 * 8 + 24, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def _sliding(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a view; zeros follow the data."""
    return np.ndarray(len(data) + 9, "<u8", _blocks(data).view(np.uint8), strides=(1,))


def _long_hash(data: np.ndarray, lower: bool, family: int) -> np.uint64:
    """What ``span_hashes`` gives for one span, a slice of it after the other."""
    total = np.zeros(1, np.uint64)
    for lo in range(0, len(data), PIECE):
        part = LOWER[data[lo : lo + PIECE]] if lower else data[lo : lo + PIECE]
        own = _blocks(part)[: (len(part) + 7) // 8]
        total += mix(own + _keys(lo // 8, lo // 8 + len(own), family)).sum(dtype=np.uint64)
    return mix(total ^ (np.array([len(data)], np.uint64) * _STEP))[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, family: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span [start, end). Hashes of different ``family`` are independent."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    blocks = _sliding(LOWER[data] if lower else data)
    keys = _keys(0, _SIDE_BY_SIDE, family)
    live, at, left = np.flatnonzero((size > 0) & (size <= 8 * _SIDE_BY_SIDE)), starts, size
    for k in range(_SIDE_BY_SIDE):
        if k:
            live = live[size[live] > 8 * k]
        if not len(live):
            break
        whole = len(live) == len(out)
        at, left = (starts, size) if whole else (starts[live], size[live])
        block = mix((blocks[at + 8 * k] & _MASKS[np.minimum(left - 8 * k, 8)]) + keys[k])
        if whole:
            out += block
        else:
            out[live] += block
    out = mix(out ^ (size.astype(np.uint64) * _STEP))
    for i in np.flatnonzero(size > 8 * _SIDE_BY_SIDE):
        out[i] = _long_hash(data[starts[i] : ends[i]], lower, family)
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span [start, end) has the bytes of the span at the same place of the second list."""
    size = ends - starts
    same = size == other_ends - others
    blocks = _sliding(data)
    live = np.flatnonzero(same & (starts != others) & (size > 0))
    for i in live[size[live] > 8 * _SIDE_BY_SIDE]:
        same[i] = np.array_equal(data[starts[i] : ends[i]], data[others[i] : other_ends[i]])
    live = live[size[live] <= 8 * _SIDE_BY_SIDE]
    for k in range(_SIDE_BY_SIDE):
        live = live[size[live] > 8 * k]
        if not len(live):
            break
        differ = (blocks[starts[live] + 8 * k] ^ blocks[others[live] + 8 * k]) & _MASKS[np.minimum(size[live] - 8 * k, 8)]
        same[live[differ != 0]] = False
    return same


def column(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE, split: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first row): like ``groups``, with longer texts cut at white space into several pieces of at most ``most`` bytes.

    A text in several pieces comes alone in each. A word of more than ``most`` bytes is a piece of its own; with ``split`` it is
    cut between characters instead, and so counts as several words.
    """
    for lo, hi in groups(offsets, most):
        start, end = int(offsets[lo]), int(offsets[hi])
        if end - start <= most:
            yield data[start:end], offsets[lo : hi + 1] - start, lo
            continue
        while start < end:
            stop = min(end, start + most)
            if stop < end:
                gaps = np.flatnonzero(WHITE[data[start:stop]])
                if len(gaps):
                    stop = start + int(gaps[-1]) + 1
                elif split:
                    while data[stop] & 0xC0 == 0x80 and stop > start + most - 4:
                        stop -= 1
                else:
                    while stop < end:
                        gaps = np.flatnonzero(WHITE[data[stop : stop + most]])
                        if len(gaps):
                            stop += int(gaps[0])
                            break
                        stop = min(end, stop + most)
            yield data[start:stop], np.array([0, stop - start]), lo
            start = stop


def spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; none reaches over the edge of a text."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = white[data]
    word = ~gap[1:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (gap[2:] | edge[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the offsets of each text's words."""
    out, counts = [np.zeros(0, np.uint64)], np.zeros(len(offsets) - 1, np.int64)
    for part, at, first in pieces(data, offsets):
        if len(part) > PIECE:  # a single long word
            out.append(np.array([_long_hash(part, lower, family)]))
            counts[first] += 1
            continue
        starts, ends = spans(part, at)
        out.append(span_hashes(part, starts, ends, lower, family))
        counts[first : first + len(at) - 1] += np.diff(np.searchsorted(starts, at))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])


def windows(words: np.ndarray, offsets: np.ndarray, width: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` words, and the offsets of each text's windows."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    total = max(0, len(words) - width + 1)
    sums = np.zeros(total, np.uint64)
    for k in range(width if total else 0):
        sums += words[k : k + total] * PLACES[64 * family + k]
    new = np.concatenate([[0], np.cumsum(counts)])
    if len(counts) == 1:
        return mix(sums[: new[-1]]), new
    at = np.arange(new[-1]) + np.repeat(offsets[:-1] - new[:-1], counts)
    return mix(sums[at]), new


def slabs(data: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first row) like ``pieces``, with longer texts cut anywhere; for counting bytes."""
    for lo, hi in groups(offsets, most):
        for start in range(int(offsets[lo]), int(offsets[hi]), most if hi == lo + 1 else int(offsets[hi] - offsets[lo]) or 1):
            stop = min(int(offsets[hi]), start + most)
            yield data[start:stop], np.array([0, stop - start]) if hi == lo + 1 else offsets[lo : hi + 1] - start, lo


def totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
