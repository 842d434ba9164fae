"""Searches inside tasks: a batch of queries over the whole graph as arrays, so that no level of half paths goes to disk.

The strategies keep their tests; what differs from the joins in ``paths`` and ``cascade`` is where half paths live. A task holds the graph
(``Graph``, both directions) and some queries at a time; levels beyond ``ROWS`` are searched slice by slice, depth first, so that
memory is bounded and nothing is cut. Queries come sorted by their targets, and what is built backwards from a target serves all queries
of it in a batch (``Batch.targets``). Graphs of more than ``IN_TASK_EDGES`` edges are searched by joins.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpath import durable
from signpath.durable import rows_of
from signpath.shipping import ship

#: Graphs of at most so many edges are sent to tasks as arrays, 10 bytes an edge and 24 a vertex.
IN_TASK_EDGES = 16_000_000
#: Half paths that are extended at once in a task.
ROWS = 300_000
#: Strategies that hold all half paths of one end go by joins where a vertex has more of them than this.
MOST_HALVES = 3_000_000
_MARKS = 21


@dataclass
class Graph:
    """Vertices by their place in ``ids``; arcs sorted by (source, target, sign), forward and backward."""

    ids: np.ndarray
    forward: tuple[np.ndarray, np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]
    _order: np.ndarray | None = None
    _rank: np.ndarray | None = None
    _walks: dict[tuple[bool, int], np.ndarray] = field(default_factory=dict)

    @staticmethod
    def of(src: np.ndarray, dst: np.ndarray, sgn: np.ndarray) -> Graph:
        ids = np.union1d(np.unique(src), np.unique(dst))
        n, a, b, positive = len(ids), _places(ids, src), _places(ids, dst), sgn == 1

        def side(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            # In place, as the driver has little memory.
            arcs = a.astype(np.int64)
            arcs *= n
            arcs += b
            arcs *= 2
            arcs += positive
            arcs.sort()
            to, sign = np.empty(len(a), np.int32), np.empty(len(a), bool)
            for lo in range(0, len(a), ROWS):
                to[lo : lo + ROWS], sign[lo : lo + ROWS] = (arcs[lo : lo + ROWS] >> 1) % n, arcs[lo : lo + ROWS] & 1
            return np.searchsorted(arcs, np.arange(n + 1) * (2 * n)), to, sign

        return Graph(ids, side(a, b), side(b, a))

    @property
    def n(self) -> int:
        return len(self.ids)

    def order(self) -> np.ndarray:
        """A number for each vertex's strong component; arcs lead to equal or larger ones."""
        if self._order is None:
            self._order = _component_order(self.forward)
        return self._order

    def rank(self) -> np.ndarray:
        """The vertices' ranks, see ``graph.ranked``."""
        if self._rank is None:
            degrees = np.diff(self.forward[0]) * np.diff(self.backward[0])
            self._rank = np.empty(self.n, np.int64)
            self._rank[np.lexsort((self.ids, -degrees))] = np.arange(1, self.n + 1)
        return self._rank

    def walks(self, arcs: tuple, hops: int) -> np.ndarray:
        """Number of walks of so many hops from each vertex, counted once for all batches of a process."""
        at = (arcs is self.forward, hops)
        if hops <= 0:
            return np.ones(self.n)
        if at not in self._walks:
            ptr, to, _ = arcs
            before, out = self.walks(arcs, hops - 1), np.empty(self.n)
            for lo, hi in spans(np.diff(ptr), ROWS):
                sums = np.concatenate([[0.0], np.cumsum(before[to[ptr[lo] : ptr[hi]]])])
                out[lo:hi] = np.diff(sums[ptr[lo : hi + 1] - ptr[lo]])
            self._walks[at] = out
        return self._walks[at]


def _places(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    out = np.empty(len(of), np.int32)
    for lo in range(0, len(of), ROWS):
        out[lo : lo + ROWS] = np.searchsorted(ids, of[lo : lo + ROWS])
    return out


def _component_order(arcs: tuple) -> np.ndarray:
    """Strong components in topological order, by depth-first search with low points (Tarjan) and an explicit stack."""
    ptr, to = array("q", arcs[0].astype(np.int64).tobytes()), array("i", arcs[1].astype(np.int32).tobytes())
    n, clock, done = len(ptr) - 1, 0, 0
    number, low, comp, at = array("q", [-1]) * n, array("q", [0]) * n, array("q", [-1]) * n, ptr[:-1]
    for root in range(n):
        if number[root] >= 0:
            continue
        number[root] = low[root] = clock
        clock += 1
        trail, stack = [root], [root]
        while stack:
            v = stack[-1]
            i, end = at[v], ptr[v + 1]
            while i < end:
                w = to[i]
                i += 1
                if number[w] < 0:
                    number[w] = low[w] = clock
                    clock += 1
                    trail.append(w)
                    stack.append(w)
                    break
                if comp[w] < 0 and number[w] < low[v]:
                    low[v] = number[w]
            else:
                stack.pop()
                if stack and low[v] < low[stack[-1]]:
                    low[stack[-1]] = low[v]
                if low[v] == number[v]:
                    while comp[v] < 0:
                        comp[trail.pop()] = done
                    done += 1
            at[v] = i
    # Components are closed after all that they lead to.
    return done - 1 - np.array(comp)


def extend(arcs: tuple, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, target, sign) of every arc from the vertices ``v``, in order, some rows at a time."""
    _, to, sign = arcs
    for row, at in places(arcs, v):
        yield row, to[at], sign[at]


def places(arcs: tuple, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place of the arc) of every arc from the vertices ``v``, in order, some rows at a time."""
    ptr = arcs[0]
    deg = ptr[v + 1] - ptr[v]
    for lo, hi in spans(deg, ROWS):
        d = deg[lo:hi]
        row = np.repeat(np.arange(lo, hi), d)
        yield row, np.arange(len(row)) + np.repeat(ptr[v[lo:hi]] - (np.cumsum(d) - d), d)


def spans(cost: np.ndarray, bound: float) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose cost is ``bound`` at most, or of one row."""
    total, lo = np.cumsum(cost), 0
    while lo < len(cost):
        hi = max(int(np.searchsorted(total, (total[lo - 1] if lo else 0) + bound, "right")), lo + 1)
        yield lo, hi
        lo = hi


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _mark(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MARKS)


class Table:
    """Sorted keys with a value each; marks rule most other keys out before the search."""

    def __init__(self, keys: np.ndarray, value: np.ndarray):
        """``keys`` are sorted already."""
        self.keys, self.value = keys, value
        self.marks = np.zeros(1 << _MARKS, bool)
        self.marks[_mark(self.keys)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` that are known, and their places in the table."""
        maybe = np.flatnonzero(self.marks[_mark(keys)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == keys[maybe]
        return maybe[ok], at[ok]


def _has(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(keys), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)] == keys


@dataclass
class Batch:
    """Queries as places of their ends."""

    s: np.ndarray
    t: np.ndarray
    sigma: np.ndarray

    def some(self, rows: np.ndarray) -> Batch:
        return Batch(self.s[rows], self.t[rows], self.sigma[rows])

    def targets(self) -> tuple[np.ndarray, np.ndarray]:
        """The different targets, and the place of each query's own among them."""
        return np.unique(self.t, return_inverse=True)

    def __len__(self) -> int:
        return len(self.s)


def key(g: Graph, q: np.ndarray, v: np.ndarray, par: np.ndarray) -> np.ndarray:
    return (q.astype(np.int64) * g.n + v) * 2 + par


def ball(g: Graph, arcs: tuple, anchor: np.ndarray, hops: int, signed: bool = True) -> Table:
    """Least number of hops of a walk of each sign from each anchor; without signs all are positive."""
    now = key(g, np.arange(len(anchor)), anchor, np.ones(len(anchor), np.int64))
    known, seen = [now << 7], now
    for d in range(1, hops + 1):
        v, par, of = (now >> 1) % g.n, (now & 1).astype(bool), (now >> 1) // g.n
        found = [key(g, of[row], w, (par[row] == sign) if signed else np.ones(len(w), np.int64)) for row, w, sign in extend(arcs, v)]
        now = distinct(np.concatenate(found)) if found else now[:0]
        if d < hops:
            now = now[~_has(seen, now)]
            seen = np.sort(np.concatenate([seen, now]))
        known.append((now << 7) + d)
    # A state's least distance comes first.
    states = np.sort(np.concatenate(known))
    first = np.concatenate([[True], states[1:] >> 7 != states[:-1] >> 7]) if len(states) else np.zeros(0, bool)
    states = states[first]
    return Table(states >> 7, (states & 127).astype(np.int8))


def rounds(k: int) -> list[int]:
    """Hop bounds of the rounds; queries that are answered within few hops never see larger balls.

    Up to five hops two are walked from each source, so that most of the work is the targets', which queries share.
    """
    return [2, *range(5, k), k] if k > 2 else [k]


def _by_rounds(queries: Batch, k: int, one: Callable[[Batch, int], np.ndarray]) -> np.ndarray:
    hit = np.zeros(len(queries), bool)
    for bound in rounds(k):
        left = np.flatnonzero(~hit)
        if len(left):
            hit[left] = one(queries.some(left), bound)
    return hit


def _descend(g: Graph, arcs: tuple, queries: Batch, k: int, fits: Callable, hit: np.ndarray) -> None:
    """Simple paths from s to t, level by level or, where a level is large, slice by slice; ``fits`` sees (d, row's query, end, sign, paths, row)."""

    def go(d: int, q: np.ndarray, par: np.ndarray, path: list[np.ndarray]) -> None:
        if d > k or not len(q):
            return
        held, size = [], 0
        for row, w, sign in extend(arcs, path[-1]):
            own, p = q[row], par[row] == sign
            ok = fits(d, own, w, p, path, row)
            ok = ok[~hit[own[ok]]]
            for x in path:
                ok = ok[x[row[ok]] != w[ok]]
            row, w, p, own = row[ok], w[ok], p[ok], own[ok]
            end = w == queries.t[own]
            hit[own[end & (p == queries.sigma[own])]] = True
            on = np.flatnonzero(~end & ~hit[own])
            held.append((own[on], p[on], *(x[row[on]] for x in path), w[on]))
            size += len(on)
            if size > ROWS:
                own, p, *more = (np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
                go(d + 1, own, p, more)
        if size:
            own, p, *more = (np.concatenate(x) for x in zip(*held, strict=True))
            go(d + 1, own, p, more)

    start = np.arange(len(queries))
    go(1, start, np.ones(len(queries), bool), [queries.s.astype(np.int32)])


def guided(g: Graph, queries: Batch, k: int, signed: bool = True) -> np.ndarray:
    """Which queries have a simple path of their sign, by half paths from s that can still reach t within the remaining hops."""

    def one(some: Batch, bound: int) -> np.ndarray:
        half, (anchors, place) = bound // 2, some.targets()
        rest = ball(g, g.backward, anchors, bound - half, signed)
        hit = np.zeros(len(some), bool)

        def fits(d, q, w, par, path, row):
            if d < half:
                return np.arange(len(w))
            at, where = rest.find(key(g, place[q], w, (par == some.sigma[q]) if signed else np.ones(len(w), np.int64)))
            return at[rest.value[where] <= bound - d]

        _descend(g, g.forward, some, bound, fits, hit)
        return hit

    return _by_rounds(queries, k, one)


def _levels(g: Graph, arcs: tuple, start: np.ndarray, hops: int, stop: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(place of the start, sign, path) of all simple half paths of 0, 1, .. hops that don't go on from ``stop``."""
    q, par, path = np.arange(len(start)), np.ones(len(start), bool), [start.astype(np.int32)]
    yield q, par, path
    for _ in range(hops):
        found = []
        if stop is not None:
            on = np.flatnonzero(path[-1] != stop[q])
            q, par, path = q[on], par[on], [x[on] for x in path]
        for row, w, sign in extend(arcs, path[-1]):
            good = np.ones(len(w), bool)
            for x in path:
                good &= x[row] != w
            found.append((row[good], w[good], (par[row] == sign)[good]))
        row, w, p = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (q[:0], path[-1][:0], par[:0])
        q, par, path = q[row], p, [*(x[row] for x in path), w]
        yield q, par, path


def _split(size: int) -> tuple[int, int]:
    """Edges of the half paths from both ends that make up paths of ``size`` edges, with one between them; targets get more, as queries share them."""
    back = min((size + 1) // 2, size - 1)
    return size - 1 - back, back


def _met(g: Graph, queries: Batch, place: np.ndarray, ahead: tuple, back: tuple, signed: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, sign) of each simple path that is a half path of ``ahead``, one more edge, and a half path of ``back``, which ends in t.

    ``back`` goes by the places of the targets, and may pass s; such paths don't fit any of ``ahead``. With ``signed``, only paths of the query's sign.
    """
    bq, bpar, bpath = back
    keys = key(g, bq, bpath[-1], bpar if signed else np.zeros(len(bq), np.int64))
    order = np.argsort(keys)
    keys = keys[order]
    known = distinct(keys)
    table = Table(known, known)
    q, par, path = ahead
    inner = np.flatnonzero(path[-1] != queries.t[q])
    q, par, path = q[inner], par[inner], [x[inner] for x in path]
    for row, w, sign in extend(g.forward, path[-1]):
        own, p = q[row], par[row] == sign
        mine = key(g, place[own], w, (p == queries.sigma[own]) if signed else np.zeros(len(w), np.int64))
        ok, _ = table.find(mine)
        good = np.ones(len(ok), bool)
        for x in path:
            good &= x[row[ok]] != w[ok]
        ok = ok[good]
        lo, hi = np.searchsorted(keys, mine[ok]), np.searchsorted(keys, mine[ok], "right")
        for a, b in spans(hi - lo, ROWS):
            n = hi[a:b] - lo[a:b]
            one = np.repeat(ok[a:b], n)
            two = order[np.arange(len(one)) + np.repeat(lo[a:b] - (np.cumsum(n) - n), n)]
            good = np.ones(len(one), bool)
            # The last vertex of either half is the one where they meet.
            for y in bpath[:-1]:
                good &= y[two] != w[one]
                for x in path:
                    good &= y[two] != x[row[one]]
            one, two = one[good], two[good]
            yield own[one], p[one] == bpar[two]


def halves(g: Graph, queries: Batch, k: int) -> np.ndarray:
    """Which queries have a simple path of their sign, by all half paths from both ends, without any pruning, shorter paths first."""
    hit = np.zeros(len(queries), bool)
    for size in range(1, k + 1):
        left = np.flatnonzero(~hit)
        if not len(left):
            break
        some, (one, two) = queries.some(left), _split(size)
        anchors, place = some.targets()
        *_, ahead = _levels(g, g.forward, some.s, one, some.t)
        *_, back = _levels(g, g.backward, anchors, two)
        for q, _ in _met(g, some, place, ahead, back, True):
            hit[left[q]] = True
    return hit


def counts(g: Graph, queries: Batch, k: int) -> np.ndarray:
    """How many simple paths each query has, by length from 1 and sign (negative, positive)."""
    out = np.zeros((len(queries), k, 2), np.int64)
    (anchors, place), splits = queries.targets(), [_split(size) for size in range(1, k + 1)]
    ahead = list(_levels(g, g.forward, queries.s, max(one for one, _ in splits), queries.t))
    back = list(_levels(g, g.backward, anchors, max(two for _, two in splits)))
    for size, (one, two) in enumerate(splits, 1):
        for q, par in _met(g, queries, place, ahead[one], back[two], False):
            np.add.at(out, (q, size - 1, par.astype(np.int64)), 1)
    return out


def witnessed(g: Graph, queries: Batch, k: int) -> np.ndarray:
    """The outcome of each query's least shortest witness (see ``cascade.witnesses``): 2 simple, 0 not simple, -2 none."""
    stage = np.full(len(queries), -2)
    for bound in rounds(k):
        left = np.flatnonzero(stage == -2)
        if len(left):
            stage[left] = _witnessed(g, queries.some(left), bound)
    return stage


def _witnessed(g: Graph, some: Batch, k: int) -> np.ndarray:
    half, (anchors, place) = k // 2, some.targets()
    rest = ball(g, g.backward, anchors, k - half)
    stage = np.full(len(some), -2)
    # Rows stay in order of their paths, so that the first row of a state has its least path. Parallel arcs of both signs give equal paths.
    q, v, par = np.arange(len(some)), some.s, np.ones(len(some), bool)
    rank = q
    seen, trail = np.sort(key(g, q, v, par)), [(v, np.zeros(len(v), np.int64))]
    for d in range(1, k + 1):
        on = np.flatnonzero((v != some.t[q]) & (stage[q] == -2))
        found = []
        for row, w, sign in extend(g.forward, v[on]):
            row = on[row]
            own, p = q[row], par[row] == sign
            if d >= half:
                at, where = rest.find(key(g, place[own], w, p == some.sigma[own]))
                ok = at[rest.value[where] <= k - d]
                row, w, p, own = row[ok], w[ok], p[ok], own[ok]
            state = key(g, own, w, p)
            ok = np.flatnonzero((w != some.s[own]) & ~_has(seen, state))
            found.append((row[ok], w[ok], p[ok], state[ok]))
        if not found:
            break
        row, w, p, state = (np.concatenate(x) for x in zip(*found, strict=True))
        path = rank[row] * g.n + w
        order = np.argsort(path, kind="stable")
        row, w, p, state, path = row[order], w[order], p[order], state[order], path[order]
        order = np.argsort(state, kind="stable")
        first = np.concatenate([[True], state[order][1:] != state[order][:-1]]) if len(order) else np.zeros(0, bool)
        one = np.sort(order[first])
        seen = np.sort(np.concatenate([seen, state[one]]))
        q, v, par, path = q[row[one]], w[one], p[one], path[one]
        rank = np.cumsum(np.concatenate([[0], path[1:] != path[:-1]]))[: len(one)]
        trail.append((v, row[one]))
        hit = np.flatnonzero((v == some.t[q]) & (par == some.sigma[q]))
        if len(hit):
            path, at = [], hit
            for vertex, before in reversed(trail):
                path.append(vertex[at])
                at = before[at]
            simple = np.ones(len(hit), bool)
            for i, x in enumerate(path):
                for y in path[:i]:
                    simple &= x != y
            stage[q[hit]] = np.where(simple, 2, 0)
    return stage


def cuts(g: Graph, queries: Batch, hops: int) -> list[tuple[Table, np.ndarray]]:
    """For 0 to ``hops``: states (vertex, sign) that walks of at most so many edges from s reach, and the vertices on all of these walks.

    A state's cut is a row of places, -1 where there are fewer; the table's values are rows. Walks aren't extended into their own cut.
    """
    q = np.arange(len(queries))
    state, cut = key(g, q, queries.s, np.ones(len(q), np.int64)), np.zeros((len(q), 0), np.int32)
    out = [(Table(state, np.arange(len(state))), cut)]
    for _ in range(hops):
        of, v, par = (state >> 1) // g.n, (state >> 1) % g.n, (state & 1).astype(bool)
        on = np.flatnonzero(v != queries.t[of])
        states, rows = [state], [np.concatenate([cut, np.full((len(cut), 1), -1, np.int32)], axis=1)]
        for row, w, sign in extend(g.forward, v[on]):
            row = on[row]
            ok = np.flatnonzero((w != queries.s[of[row]]) & ~(cut[row] == w[:, None]).any(axis=1))
            row, w = row[ok], w[ok]
            states.append(key(g, of[row], w, par[row] == sign[ok]))
            rows.append(np.concatenate([cut[row], w[:, None].astype(np.int32)], axis=1))
        state, cut = np.concatenate(states), np.concatenate(rows)
        order = np.argsort(state, kind="stable")
        state, cut = state[order], cut[order]
        begin = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]]))
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(state))))
        least = cut[begin].copy()
        for j in range(least.shape[1]):
            held = (cut == least[group, j][:, None]).any(axis=1)
            least[~np.logical_and.reduceat(held, begin), j] = -1
        state, cut = state[begin], least
        out.append((Table(state, np.arange(len(state))), cut))
    return out


def cut_guided(g: Graph, queries: Batch, k: int) -> np.ndarray:
    """Which queries have a simple path of their sign, by half paths from t; one goes if all walks to its end in the hops that remain pass it."""

    def one(some: Batch, bound: int) -> np.ndarray:
        half = (bound + 1) // 2
        tables = cuts(g, some, bound - half)
        hit = np.zeros(len(some), bool)

        def fits(d, q, w, par, path, row):
            if d < half:
                return np.arange(len(w))
            table, cut = tables[bound - d]
            at, where = table.find(key(g, q, w, par == some.sigma[q]))
            own, ok = cut[table.value[where]], np.ones(len(at), bool)
            for x in path:
                ok &= ~(own == x[row[at]][:, None]).any(axis=1)
            return at[ok]

        _descend(g, g.backward, Batch(some.t, some.s, some.sigma), bound, fits, hit)
        return hit

    return _by_rounds(queries, k, one)


def between(g: Graph, some: Batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place of a forward arc), sorted: at least all arcs on walks of the query's sign from s to t of at most k edges.

    Walks neither come back to s nor go on from t. Half of the hops go by balls, the others only through what reaches t in those that remain.
    """
    half, (anchors, place) = k // 2, some.targets()
    rest = ball(g, g.backward, anchors, k - half)
    ptr, to, positive = g.forward
    now = key(g, np.arange(len(some)), some.s, np.ones(len(some), np.int64))
    seen, states, depth, arcs = now, [now], [np.zeros(len(now), np.int8)], []
    for d in range(k):
        of, v, par = (now >> 1) // g.n, (now >> 1) % g.n, (now & 1).astype(bool)
        on = np.flatnonzero(v != some.t[of])
        found = []
        for row, at in places(g.forward, v[on]):
            row = on[row]
            w, own, p = to[at], of[row], par[row] == positive[at]
            asked = p == some.sigma[own]
            ok = np.flatnonzero((w != some.s[own]) & (asked | (w != some.t[own])))
            if d + 1 >= half:
                known, where = rest.find(key(g, place[own[ok]], w[ok], asked[ok]))
                ok = ok[known[rest.value[where] <= k - d - 1]]
            to_state = key(g, own[ok], w[ok], p[ok])
            arcs.append((now[row[ok]], to_state, at[ok]))
            fresh = distinct(to_state)
            found.append(fresh[~_has(seen, fresh)])
        now = distinct(np.concatenate(found)) if found else now[:0]
        if not len(now):
            break
        states.append(now)
        depth.append(np.full(len(now), d + 1, np.int8))
        seen = np.sort(np.concatenate([seen, now]))
    if not arcs:
        return now[:0], now[:0]
    one, two, at = (np.concatenate(x) for x in zip(*arcs, strict=True))
    order = np.argsort(np.concatenate(states))
    depth = np.concatenate(depth)[order]
    # Hops that remain from each state: known within the backward ball, and told back along the arcs beyond it.
    own, v, par = (seen >> 1) // g.n, (seen >> 1) % g.n, (seen & 1).astype(bool)
    left = np.full(len(seen), 100, np.int8)
    known, where = rest.find(key(g, place[own], v, par == some.sigma[own]))
    left[known] = rest.value[where]
    one, two = np.searchsorted(seen, one), np.searchsorted(seen, two)
    for _ in range(half):
        np.minimum.at(left, one, left[two] + np.int8(1))
    good = np.flatnonzero(depth[one].astype(np.int64) + 1 + left[two] <= k)
    m = len(to)
    both = distinct(own[one[good]] * m + at[good])
    return both // m, both % m


def _each(g: Graph, some: Batch, k: int) -> Iterator[tuple[int, list[tuple[int, int, int]], int, int, int]]:
    """(query, arcs, s, t, sigma) of the queries that have any arcs ``between`` their ends."""
    of, at = between(g, some, k)
    ptr, to, positive = g.forward
    src = np.searchsorted(ptr, at, side="right") - 1
    rows = list(zip(src.tolist(), to[at].tolist(), positive[at].astype(int).tolist(), strict=True))
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    own = of[begin]
    ends = zip(own.tolist(), begin.tolist(), [*begin[1:].tolist(), len(of)], some.s[own].tolist(), some.t[own].tolist(), some.sigma[own].astype(int).tolist(), strict=True) if len(of) else ()
    for q, lo, hi, s, t, sigma in ends:
        yield q, rows[lo:hi], s, t, sigma


def _each_bound(k: int, one: Callable[[list, int, int, int, int], bool]) -> Callable[[Graph, Batch], np.ndarray]:
    """Searches of one query's arcs at a time, with growing hop bounds, so that most queries are answered over few arcs."""

    def run(g: Graph, queries: Batch) -> np.ndarray:
        hit = np.zeros(len(queries), bool)
        for bound in range(min(2, k), k + 1):
            left = np.flatnonzero(~hit)
            if len(left):
                for q, arcs, s, t, sigma in _each(g, queries.some(left), bound):
                    hit[left[q]] = one(arcs, s, t, sigma, bound)
        return hit

    return run


def branched(g: Graph, queries: Batch, k: int) -> np.ndarray:
    """Which queries have a simple path of their sign, by branch and bound over shortest walks."""
    from . import kernels  # which imports what imports this module

    return _each_bound(k, lambda *x: kernels.shortest_simple(*x) is not None)(g, queries)


def blocked(g: Graph, queries: Batch, k: int) -> np.ndarray:
    """Which queries have a simple path of their sign, from one biconnected block to the next, if the order of strong components allows it."""
    from . import kernels

    order = g.order()
    hit = np.zeros(len(queries), bool)
    possible = np.flatnonzero(order[queries.s] <= order[queries.t])
    hit[possible] = _each_bound(k, lambda *x: kernels.shortest_by_blocks(*x)[0] is not None)(g, queries.some(possible))
    return hit


def labelled(g: Graph, queries: Batch, k: int) -> np.ndarray:
    """Outcome codes by the two-hop labels of both ends (see ``labels``): 1 a simple witness, -1 no common hub, else those of the cascade.

    A query's labels are made from the arcs between its ends, where all of its simple paths lie.
    """
    stage, rank = np.full(len(queries), -1), g.rank()
    for q, arcs, s, t, sigma in _each(g, queries, k):
        stage[q] = _label_verdict(arcs, s, t, sigma, k, rank)
    rest = np.flatnonzero(stage == 0)
    if len(rest):
        stage[rest] = KERNELS["cascade"](g, queries.some(rest), k)
    return stage


def _label_verdict(arcs: list[tuple[int, int, int]], s: int, t: int, sigma: int, k: int, rank: np.ndarray) -> int:
    ahead: dict[int, list] = {}
    back: dict[int, list] = {}
    for a, b, g in arcs:
        ahead.setdefault(a, []).append((b, g))
        back.setdefault(b, []).append((a, g))
    met = -1
    for hub in {v for a, b, _ in arcs for v in (a, b)}:
        into = _labels_of(ahead, hub, t, k, rank)
        out = _labels_of(back, hub, s, k, rank) if into else {}
        for p1, w1 in out.items():
            for p2, w2 in into.items():
                if int(p1 == p2) == sigma and len(w1) + len(w2) - 2 <= k:
                    if len({*w1, *w2}) == len(w1) + len(w2) - 1:
                        return 1
                    met = 0
    return met


def _labels_of(near: dict[int, list], hub: int, end: int, k: int, rank: np.ndarray) -> dict[int, tuple]:
    """Least shortest walk of each sign from ``hub`` to ``end`` through vertices of lower priority."""
    level, known = {(hub, 1): (hub,)}, {(hub, 1)}
    out = {1: (hub,)} if hub == end else {}
    for _ in range(k):
        new: dict[tuple, tuple] = {}
        for (v, par), path in level.items():
            for w, g in near.get(v, ()):
                state = (w, int(par == g))
                if rank[w] > rank[hub] and state not in known:
                    new[state] = min(new.get(state, (*path, w)), (*path, w))
        known |= new.keys()
        for par in (0, 1):
            if (end, par) in new:
                out.setdefault(par, new[end, par])
        level = new
        if not level or len(out) == 2:
            break
    return out


def _staged(exact: Callable[[Graph, Batch, int], np.ndarray]) -> Callable[[Graph, Batch, int], np.ndarray]:
    def run(g: Graph, queries: Batch, k: int) -> np.ndarray:
        stage = witnessed(g, queries, k)
        rest = np.flatnonzero(stage == 0)
        if len(rest):
            stage[rest] = np.where(exact(g, queries.some(rest), k), 3, -3)
        return stage

    return run


#: What finds each strategy's answers: true or false, or outcome codes for the staged ones.
KERNELS = {
    "exhaustive": halves,
    "bidirectional": halves,
    "distance_pruned": guided,
    # A state of hops and parity can still accept if a walk of the missing sign is no longer than the hops that remain.
    "automaton": guided,
    "two_sided": lambda g, q, k: guided(g, q, k, signed=False),
    "cut_pruned": cut_guided,
    "cascade": _staged(guided),
    "cut_cascade": _staged(cut_guided),
}

#: Strategies that make a graph of each query's own arcs, and alternating segments: a half path inside a segment is a negative one.
BY_QUERY = {
    "branch_and_bound": branched,
    "components": blocked,
    "labels": labelled,
    "balanced": guided,
}


def fits(edges: DataFrame, k: int, whole: bool = False) -> bool:
    """Whether the graph goes to tasks. With ``whole``, a task also has to hold all half paths into any vertex.

    Runs whose levels are counted (``durable.tallied``) go by joins.
    """
    if durable._tallies or k < 1 or not 0 < rows_of(edges) <= IN_TASK_EDGES:
        return False
    return not whole or _most_walks(edges, _split(k)[1]) <= MOST_HALVES


_sent: dict[tuple, tuple] = {}
#: Walks into vertices are counted for so many hops before a graph is sent.
_COUNTED = 5


def _most_walks(edges: DataFrame, hops: int) -> float:
    """Most walks of so many hops into a vertex."""
    sent, most = _made(edges)
    if hops < len(most):
        return most[hops]
    g = sent.value
    return g.walks(g.backward, hops).max()


def _broadcast(edges: DataFrame):
    return _made(edges)[0]


def _made(edges: DataFrame) -> tuple:
    """The graph as a broadcast, and the most walks of 0, 1, .. hops into a vertex."""
    sc = edges.sparkSession.sparkContext
    at = (sc.applicationId, getattr(edges, "_stored_at", None))
    made = _sent.get(at) if at[1] else None
    if made is None:
        g = Graph.of(*_collected(edges))
        most = [float(g.walks(g.backward, h).max(initial=0)) for h in range(_COUNTED + 1)]
        g._walks.clear()
        made = sc.broadcast(g), most
        if at[1]:
            _sent[at] = made
    return made


def _collected(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sources, targets and signs; 8 bytes an edge come to the driver where vertices have at most 31 bits, else 20."""
    low, high = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    if low is None or low < 0 or high >= 1 << 31:
        rows = edges.select("src", "dst", "sgn").toArrow()
        return tuple(rows.column(i).to_numpy() for i in range(3))
    packed = F.shiftleft(F.col("src").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("dst").cast("bigint"), 1)).bitwiseOR((F.col("sgn") == 1).cast("bigint"))
    arcs = edges.select(packed.alias("arc")).toArrow().column(0).to_numpy()
    src, dst, sgn = np.empty(len(arcs), np.int32), np.empty(len(arcs), np.int32), np.empty(len(arcs), np.int8)
    for lo in range(0, len(arcs), ROWS):
        some = arcs[lo : lo + ROWS]
        src[lo : lo + ROWS], dst[lo : lo + ROWS], sgn[lo : lo + ROWS] = some >> 32, (some >> 1) & ((1 << 31) - 1), some & 1
    return src, dst, sgn


def over_queries(edges: DataFrame, queries: DataFrame, k: int, answer: Callable[[Graph, Batch, np.ndarray], list], schema: str, apart: Callable[..., list] | None = None) -> DataFrame:
    """``answer`` gets the graph, queries whose ends have edges, and their qids, some queries at a time; the least and most work are bounded by ``ROWS``.

    ``apart`` gets the other queries. Queries are sorted by target; ranges also go by qid, so that a target of many queries is dealt too.
    """
    ship(edges.sparkSession)
    sent = _broadcast(edges)
    parts = max(edges.sparkSession.sparkContext.defaultParallelism * 4, rows_of(queries) // 20_000 + 1)
    ahead, back = max(k // 2 - 1, 0), k - k // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        near, far = g.walks(g.forward, ahead), g.walks(g.backward, back)
        for whole in batches:
            qid, s, t, sigma = (whole.column(i).to_numpy() for i in range(4))
            inside = _has(g.ids, s) & _has(g.ids, t)
            known = np.flatnonzero(inside)
            if apart and len(known) < len(qid):
                yield batch_of(apart(*(x[~inside] for x in (qid, s, t, sigma))))
            qid, s, t, sigma = qid[known], np.searchsorted(g.ids, s[known]), np.searchsorted(g.ids, t[known]), sigma[known] == 1
            fresh = np.append(True, t[1:] != t[:-1])[: len(t)]
            for lo, hi in spans(near[s] + far[t] * fresh + 1, ROWS):
                out = answer(g, Batch(s[lo:hi], t[lo:hi], sigma[lo:hi]), qid[lo:hi])
                if len(out[0]):
                    yield batch_of(out)

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    asked = queries.select(*(F.col(c).cast("bigint").alias(c) for c in ("qid", "s", "t")), F.col("sigma").cast("int").alias("sigma"))
    return asked.repartitionByRange(parts, "t", "qid").sortWithinPartitions("t").mapInArrow(run, schema)


def found(edges: DataFrame, queries: DataFrame, k: int, strategy: str) -> DataFrame:
    """(qid, s, t, sigma, stage) of each query: 1 with a path and 0 without, or the outcome code for staged strategies.

    Rows come from the tasks whole, so that answers aren't joined to their queries.
    """
    kernel, staged = (KERNELS | BY_QUERY)[strategy], strategy in ("cascade", "cut_cascade", "labels")

    def answer(g: Graph, some: Batch, qid: np.ndarray) -> list[np.ndarray]:
        return [qid, g.ids[some.s].astype(np.int64), g.ids[some.t].astype(np.int64), some.sigma.astype(np.int32), kernel(g, some, k).astype(np.int32)]

    def apart(qid: np.ndarray, s: np.ndarray, t: np.ndarray, sigma: np.ndarray) -> list[np.ndarray]:
        # Ends without edges have no walk and no hub.
        return [qid, s, t, sigma, np.full(len(qid), (-1 if strategy == "labels" else -2) if staged else 0, np.int32)]

    out = over_queries(edges, queries, k, answer, "qid long, s long, t long, sigma int, stage int", apart)
    return out.select(*(F.col(c).cast(queries.schema[c].dataType).alias(c) for c in ("qid", "s", "t", "sigma")), "stage")


def counts_by_sign(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, len, par, paths), see ``paths.counts_by_sign``."""

    def answer(g: Graph, some: Batch, qid: np.ndarray) -> list[np.ndarray]:
        got = counts(g, some, k)
        q, size, par = np.nonzero(got)
        return [qid[q], (size + 1).astype(np.int32), par.astype(np.int32), got[q, size, par]]

    return over_queries(edges, queries, k, answer, "qid long, len int, par int, paths long")
