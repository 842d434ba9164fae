import random

import numpy as np
import pytest

from signpath.operators import intask
from signpath.plans.reach import reach

from .brute import answer, simple_paths

EDGES = "src long, dst long, sgn int"
QUERIES = "qid long, s long, t long, sigma int"


def _graphs(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n = rng.randint(3, 7)
        edges = [(7 * a + 2, 7 * b + 2, g) for a in range(n) for b in range(n) if a != b for g in (0, 1) if rng.random() < 0.22]
        if edges:
            yield edges, intask.Graph.of(*(np.array(x) for x in zip(*edges, strict=True)))


def _all_pairs(g):
    asked = [(a, b, x) for a in range(g.n) for b in range(g.n) if a != b for x in (False, True)]
    return asked, intask.Batch(*(np.array(x) for x in zip(*asked, strict=True)))


@pytest.mark.parametrize("rows", [5, 300_000])
def test_kernels_follow_the_definition(monkeypatch, rows):
    """Also where every level is searched slice by slice."""
    monkeypatch.setattr(intask, "ROWS", rows)
    for edges, g in _graphs(5, 10):
        asked, batch = _all_pairs(g)
        for k in (1, 3, 6):
            paths = [list(simple_paths(edges, g.ids[a], g.ids[b], k)) for a, b, _ in asked]
            want = [any(par == x for par, _ in own) for own, (_, _, x) in zip(paths, asked, strict=True)]
            for name, kernel in intask.KERNELS.items():
                assert list(kernel(g, batch, k) > 0) == want, (name, k, edges)
            counted = intask.counts(g, batch, k)
            for own, row in zip(paths, counted, strict=True):
                assert {(size, par): row[size - 1, par] for size in range(1, k + 1) for par in (0, 1)} == {(size, par): own.count((par, size)) for size in range(1, k + 1) for par in (0, 1)}


def test_witnesses_are_least_where_parallel_arcs_tie():
    # Both ways to 5 are walks of three edges; the lesser goes over 2, whatever the sign of its first arc, and is simple.
    edges = [(0, 1, 0), (0, 1, 1), (1, 2, 0), (1, 3, 1), (2, 5, 1), (3, 5, 0)]
    g = intask.Graph.of(*(np.array(x) for x in zip(*edges, strict=True)))
    assert list(intask.witnessed(g, intask.Batch(np.array([0, 0]), np.array([4, 4]), np.array([True, False])), 4)) == [2, 2]
    circuit = [(0, 1, 1), (1, 2, 1), (2, 3, 0), (3, 1, 1), (1, 4, 1)]
    g = intask.Graph.of(*(np.array(x) for x in zip(*circuit, strict=True)))
    one = intask.Batch(np.array([0]), np.array([4]), np.array([False]))
    assert intask.witnessed(g, one, 6)[0] == 0 and intask.witnessed(g, one, 3)[0] == -2
    assert intask.KERNELS["cascade"](g, one, 6)[0] == -3


@pytest.mark.parametrize("strategy", list(intask.KERNELS))
def test_no_level_goes_to_disk(spark, monkeypatch, strategy):
    """The joins, for larger graphs, give the same answers and codes."""
    from signpath import durable

    rng = random.Random(8)
    edges = [(a, b, g) for a in range(9) for b in range(9) if a != b for g in (0, 1) if rng.random() < 0.12]
    asked = [(9 * a + b, a, b, x) for a in range(10) for b in range(9) for x in [(a + b) % 2]]
    e, q = spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, QUERIES)
    written, plain = [], durable.stored
    monkeypatch.setattr(durable, "stored", lambda df, name: written.append(name) or plain(df, name))
    got = {r.qid: (r.result, r.stage) for r in reach(e, q, 5, strategy).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: answer(edges, s, t, x, 5, 9) for i, s, t, x in asked}
    assert not {"paths", "witness", "forward", "backward", "cut-paths"} & set(written)
    monkeypatch.setattr(intask, "IN_TASK_EDGES", 0)
    assert {r.qid: (r.result, r.stage) for r in reach(e, q, 5, strategy).collect()} == got
    assert {"paths", "witness", "forward", "cut-paths"} & set(written)


@pytest.mark.parametrize("rows", [5, 300_000])
def test_kernels_of_own_arcs_follow_the_definition(monkeypatch, rows):
    monkeypatch.setattr(intask, "ROWS", rows)
    for edges, g in _graphs(6, 12):
        asked, batch = _all_pairs(g)
        for k in (1, 2, 3, 5, 6):
            want = [any(par == x for par, _ in simple_paths(edges, g.ids[a], g.ids[b], k)) for a, b, x in asked]
            for name, kernel in intask.BY_QUERY.items():
                got, asks = list(kernel(g, batch, k) > 0), [x if name == "balanced" else True for _, _, x in asked]
                assert [a for a, y in zip(got, asks, strict=True) if y] == [b for b, y in zip(want, asks, strict=True) if y], (name, k, edges)


def test_component_order_and_ranks():
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (6, 0), (4, 5), (6, 5)]
    g = intask.Graph.of(*(np.array(x) for x in zip(*edges, strict=True)), np.ones(len(edges), int))
    order = g.order()
    assert order[0] == order[1] == order[2] and order[3] == order[4] and len(set(order)) == 4
    assert all(order[a] <= order[b] for a, b in edges)
    n = 50_000
    chain = np.arange(n)
    assert list(intask.Graph.of(chain, chain + 1, np.ones(n, int)).order()) == list(range(n + 1))
    assert list(g.rank()) == [1, 5, 2, 3, 4, 6, 7]


@pytest.mark.parametrize("strategy", list(intask.BY_QUERY))
def test_own_arcs_go_neither_to_disk_nor_through_joins(spark, monkeypatch, strategy):
    from signpath import durable
    from signpath.operators import balanced, components, kernels, labels, paths

    rng = random.Random(9)
    edges = [(a, b, g) for a in range(9) for b in range(9) if a != b for g in (0, 1) if rng.random() < 0.12]
    asked = [(9 * a + b, a, b, x) for a in range(10) for b in range(9) for x in [(a + b) % 2]]
    e, q = spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, QUERIES)
    written, plain = [], durable.stored
    for module in (durable, balanced, components, labels, paths):
        monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or plain(df, name))
    want = {i: -1 if strategy == "balanced" and x != 1 else answer(edges, s, t, x, 5, 9) for i, s, t, x in asked}
    assert {r.qid: r.result for r in reach(e, q, 5, strategy).collect()} == want
    assert not written


def test_what_is_built_from_a_target_serves_all_its_queries(monkeypatch):
    edges, g = next(_graphs(11, 1))
    asked, batch = _all_pairs(g)
    built, plain = [], intask.ball
    monkeypatch.setattr(intask, "ball", lambda g, arcs, anchor, *x: built.append(len(anchor)) or plain(g, arcs, anchor, *x))
    for name in ("distance_pruned", "two_sided", "cascade", "branch_and_bound", "components", "labels"):
        (intask.KERNELS | intask.BY_QUERY)[name](g, batch, 5)
        assert built and max(built) <= g.n < len(asked)
        built.clear()
    starts, levels = [], intask._levels
    monkeypatch.setattr(intask, "_levels", lambda g, arcs, start, *x: starts.append((arcs is g.backward, len(start))) or levels(g, arcs, start, *x))
    intask.halves(g, batch, 5), intask.counts(g, batch, 5)
    assert max(n for back, n in starts if back) <= g.n


def test_graphs_of_sixty_copies_go_to_tasks(spark):
    """Succession of customers over all orders at 60 times sf0.1 has 8,998,079 edges."""
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 0)], EDGES)
    e._seen = {"rows": 8_998_079}
    assert intask.fits(e, 6) and intask.fits(e, 6, whole=True)


@pytest.mark.parametrize("far", [0, 2**31 - 3, 2**31 - 2, 2**40])
def test_collected_edges_are_whole(spark, far):
    edges = [(far, far + 1, 1), (far + 1, far, 0), (far, far + 1, 0), (0, far + 1, 1)]
    src, dst, sgn = intask._collected(spark.createDataFrame(edges, EDGES))
    assert sorted(zip(src.tolist(), dst.tolist(), sgn.tolist(), strict=True)) == sorted(edges)
    g = intask.Graph.of(src, dst, sgn)
    ptr, to, sign = g.forward
    assert sorted((int(g.ids[v]), int(g.ids[to[i]]), int(sign[i])) for v in range(g.n) for i in range(ptr[v], ptr[v + 1])) == sorted(edges)


@pytest.mark.parametrize("strategy", ["exhaustive", "cascade", "labels", "balanced"])
def test_answers_come_without_joins_in_the_types_of_their_queries(spark, strategy):
    from signpath.durable import stored

    edges = [(0, 1, 1), (1, 2, 0), (2, 3, 1), (5, 6, 1)]
    asked = [(i, s, t, x) for i, (s, t, x) in enumerate((s, t, x) for s in range(8) for t in (0, 2, 3, 4, 9) for x in (0, 1))]
    e, q = spark.createDataFrame(edges, EDGES), stored(spark.createDataFrame(asked, "qid int, s int, t int, sigma int"), "asked")
    got = reach(e, q, 4, strategy)
    assert [got.schema[c].dataType for c in ("qid", "s", "t")] == [q.schema[c].dataType for c in ("qid", "s", "t")]
    want = {i: -1 if strategy == "balanced" and x != 1 else answer(edges, s, t, x, 4, 7) for i, s, t, x in asked}
    rows = got.collect()
    assert len(rows) == len(asked) and {r.qid: r.result for r in rows} == want
    assert {(r.qid, r.s, r.t, r.sigma) for r in rows} == set(asked)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
