"""Searches that need an early stop inside a level: one query's pruned edges at a time, in Python.

Each group holds the edges between one query's ends within the hop bound (see ``paths.pruned_edges``), not the graph.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpath.functions.signs import edge_key
from signpath.shipping import ship

from .paths import pruned_edges


def first_path(edges: list[tuple[int, int, int, int]], s: int, t: int, sigma: int, k: int) -> bool:
    """Depth-first search with an explicit stack; ``edges`` are (src, dst, sgn, hops from dst to t)."""
    out = defaultdict(list)
    for src, dst, sgn, h in edges:
        out[src].append((h, dst, sgn))
    for v in out:
        out[v].sort(reverse=True)
    path, on_path = [(s, 1, iter(sorted(out[s])))], {s}
    while path:
        v, par, left = path[-1]
        for h, w, sgn in left:
            if w in on_path or len(path) + h > k:
                continue
            p = int(par == sgn)
            if w == t:
                if p == sigma:
                    return True
                continue
            path.append((w, p, iter(sorted(out[w]))))
            on_path.add(w)
            break
        else:
            path.pop()
            on_path.discard(v)
    return False


def shortest_walk(out: dict, s: int, t: int, sigma: int, k: int, banned: frozenset) -> list[tuple[int, int, int]] | None:
    """Arcs of a shortest walk of the sign without banned arcs, by labels on (vertex, sign); the walk ends at its first t."""
    before: dict = {(s, 1): None}
    level = [(s, 1)]
    for _ in range(k):
        new = []
        for v, par in level:
            for w, sgn in out[v]:
                arc, state = (v, w, sgn), (w, int(par == sgn))
                if w == s or arc in banned or state in before:
                    continue
                before[state] = ((v, par), arc)
                if state == (t, sigma):
                    arcs = []
                    while before[state]:
                        state, arc = before[state]
                        arcs.append(arc)
                    return arcs[::-1]
                if w != t:
                    new.append(state)
        level = new
    return None


def first_circuit(arcs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]] | None:
    """The arcs between the first two visits of a vertex; None for a simple path."""
    seen = {arcs[0][0]: 0} if arcs else {}
    for i, (_, w, _) in enumerate(arcs):
        if w in seen:
            return arcs[seen[w] : i + 1]
        seen[w] = i + 1
    return None


def shortest_simple(edges: list[tuple[int, int, int]], s: int, t: int, sigma: int, k: int) -> int | None:
    """Length of a shortest simple path of the sign, by branch and bound over shortest walks.

    A simple path leaves out at least one arc of any circuit, so that a walk with a circuit branches into one
    case for each of its arcs.
    """
    out = defaultdict(list)
    for src, dst, sgn in edges:
        out[src].append((dst, sgn))
    first = shortest_walk(out, s, t, sigma, k, frozenset())
    heap, tie, done = ([(len(first), 0, first, frozenset())] if first else []), 0, set()
    while heap:
        size, _, arcs, banned = heapq.heappop(heap)
        circuit = first_circuit(arcs)
        if circuit is None:
            return size
        for arc in circuit:
            more = banned | {arc}
            if more in done:
                continue
            done.add(more)
            walk = shortest_walk(out, s, t, sigma, k, more)
            if walk:
                tie += 1
                heapq.heappush(heap, (len(walk), tie, walk, more))
    return None


def _per_query(edges: DataFrame, queries: DataFrame, k: int, answer, schema: str) -> DataFrame:
    ship(edges.sparkSession)
    ends = queries.select("qid", "s", "t", "sigma")
    return pruned_edges(edges, queries, k).join(ends, "qid").groupBy("qid").applyInPandas(answer, schema)


def local_search(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qids of the queries that ``first_path`` answers with yes."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        q = rows.iloc[0]
        hit = first_path(list(rows[["src", "dst", "sgn", "h"]].itertuples(index=False, name=None)), q.s, q.t, q.sigma, k)
        return pd.DataFrame({"qid": [q.qid] if hit else []}, dtype="int64")

    return _per_query(edges, queries, k, answer, "qid long")


def branch_and_bound(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, len) of the queries with a simple path of the sign."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        q = rows.iloc[0]
        size = shortest_simple(list(rows[["src", "dst", "sgn"]].itertuples(index=False, name=None)), q.s, q.t, q.sigma, k)
        return pd.DataFrame({"qid": [q.qid], "len": [size]}, dtype="int64") if size is not None else pd.DataFrame({"qid": [], "len": []}, dtype="int64")

    return _per_query(edges, queries, k, answer, "qid long, len long")


def blocks_of(arcs: list[tuple[int, int]]) -> list[int]:
    """Number of the biconnected block of each undirected edge, blocks numbered by their least edge, by depth-first low points."""
    near, number, low, block = defaultdict(list), {}, {}, [-1] * len(arcs)
    for i, (a, b) in enumerate(arcs):
        near[a].append((b, i))
        near[b].append((a, i))
    for root in sorted(near):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack, trail = [(root, -1, iter(near[root]))], []
        while stack:
            v, came, left = stack[-1]
            for w, i in left:
                if i == came or block[i] != -1:
                    continue
                if w not in number:
                    number[w] = low[w] = len(number)
                    trail.append(i)
                    stack.append((w, i, iter(near[w])))
                    break
                if number[w] < number[v]:
                    low[v] = min(low[v], number[w])
                    trail.append(i)
            else:
                stack.pop()
                if stack:
                    parent = stack[-1][0]
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= number[parent]:
                        own = []
                        while True:
                            own.append(trail.pop())
                            if own[-1] == came:
                                break
                        least = min(own)
                        for i in own:
                            block[i] = least
    return block


def block_chain(pairs: list[tuple[int, int]], s: int, t: int) -> list[tuple[int, int, int]]:
    """(block, entry, exit) of the biconnected blocks between s and t, in order; empty if nothing joins them.

    Blocks and the vertices that part them are a tree, so that every simple path from s to t goes through these blocks, from one
    cut vertex to the next, and through no other.
    """
    inside = defaultdict(set)
    for (a, b), block in zip(pairs, blocks_of(pairs), strict=True):
        inside[block] |= {a, b}
    of = defaultdict(list)
    for block, some in inside.items():
        for v in some:
            of[v].append(block)
    came, level = {s: None}, [s]
    used: set[int] = set()
    while level and t not in came:
        new = []
        for v in level:
            for block in of[v]:
                if block in used:
                    continue
                used.add(block)
                for w in inside[block]:
                    if w not in came:
                        came[w] = (block, v)
                        new.append(w)
        level = new
    chain, v = [], t
    while came.get(v):
        block, entry = came[v]
        chain.append((block, entry, v))
        v = entry
    return chain[::-1] if t in came else []


def shortest_by_blocks(edges: list[tuple[int, int, int]], s: int, t: int, sigma: int, k: int) -> tuple[int | None, int]:
    """Length of a shortest simple path of the sign, and the number of blocks that it goes through.

    The least lengths of both signs go from block to block; each block is solved by itself.
    """
    pairs = sorted({(min(a, b), max(a, b)) for a, b, _ in edges})
    chain = block_chain(pairs, s, t)
    at = dict(zip(pairs, blocks_of(pairs), strict=True))
    arcs = defaultdict(list)
    for a, b, g in edges:
        arcs[at[min(a, b), max(a, b)]].append((a, b, g))
    best = {1: 0}
    for block, entry, exit_ in chain:
        spare = k - min(best.values())
        inside = {g: shortest_simple(arcs[block], entry, exit_, g, spare) for g in (0, 1)}
        more: dict[int, int] = {}
        for par, size in best.items():
            for g, own in inside.items():
                if own is not None and size + own <= k:
                    more[int(par == g)] = min(size + own, more.get(int(par == g), k))
        best = more
        if not best:
            break
    return best.get(sigma) if chain else None, len(chain)


def search_by_blocks(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, len, blocks) of the queries that have any pruned edges; len is null where no simple path has the sign."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        q = rows.iloc[0]
        size, blocks = shortest_by_blocks(list(rows[["src", "dst", "sgn"]].itertuples(index=False, name=None)), q.s, q.t, q.sigma, k)
        return pd.DataFrame({"qid": [q.qid], "len": pd.array([size], "Int64"), "blocks": [blocks]})

    return _per_query(edges, queries, k, answer, "qid long, len long, blocks long")


def biconnected_blocks(edges: DataFrame, component: DataFrame) -> DataFrame:
    """(comp, a, b, block): the undirected edges inside each component and the least edge number of their block.

    A group is one component; within a query's pruned edges components are small, over a whole graph the largest
    one must fit a task.
    """
    ship(edges.sparkSession)
    one, two = (component.select(F.col("v").alias(c), F.col("comp").alias(f"comp_{c}")) for c in ("src", "dst"))
    inside = edges.join(one, "src").join(two, "dst").where("comp_src = comp_dst")
    one, two = edge_key(F.col("src"), F.col("dst"))
    pairs = inside.select(F.col("comp_src").alias("comp"), one.alias("a"), two.alias("b")).distinct()

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"], ignore_index=True)
        rows["block"] = blocks_of(list(rows[["a", "b"]].itertuples(index=False, name=None)))
        return rows[["comp", "a", "b", "block"]]

    return pairs.groupBy("comp").applyInPandas(split, "comp long, a long, b long, block long")
