import random

import pytest

from signpath.plans.reach import STRATEGIES, histogram, reach, summary

from .brute import answer, simple_paths

FIXTURES = {
    "F1": ([(0, 1, 1), (1, 2, 0), (0, 2, 1), (2, 3, 0)], [(0, 2, 1, 1, 1), (0, 2, 0, 1, 0), (0, 2, 0, 2, 1), (0, 3, 1, 2, 0), (0, 3, 1, 3, 1), (0, 3, 0, 2, 1), (3, 0, 1, 3, 0), (0, 0, 1, 0, 1), (0, 0, 0, 0, 0)]),
    "F2": ([(0, 1, 1), (1, 2, 1), (2, 3, 0), (3, 1, 1), (1, 4, 1)], [(0, 4, 1, 2, 1), (0, 4, 0, 4, 0), (0, 4, 0, 5, 0), (0, 4, 0, 6, 0)]),
    "F3": ([(0, 1, 1), (0, 1, 0)], [(0, 1, 1, 1, 1), (0, 1, 0, 1, 1)]),
    "F4": ([(0, 1, 1), (1, 2, 1), (2, 7, 1), (7, 5, 1), (1, 3, 1), (3, 4, 1), (4, 5, 1), (5, 1, 1), (5, 6, 1), (6, 7, 0), (7, 8, 1)], [(0, 8, 0, 6, 0), (0, 8, 0, 7, 1), (0, 8, 1, 4, 1)]),
    "F5": ([(0, 1, 1), (1, 2, 0), (2, 1, 1)], [(0, 1, 0, 1, 0), (0, 1, 0, 3, 0), (0, 1, 1, 1, 1)]),
    "F6": ([(0, 1, 1), (1, 2, 1)], [(0, 2, 1, 1, 0), (0, 2, 1, 2, 1)]),
}


def test_golden_answers_of_the_definition():
    for edges, asked in FIXTURES.values():
        for s, t, sigma, k, want in asked:
            assert answer(edges, s, t, sigma, k, 9) == want


def _world():
    """All fixtures and some random graphs side by side, with all pairs of their ends as queries."""
    rng = random.Random(4)
    graphs = [e for e, _ in FIXTURES.values()]
    for _ in range(6):
        n = rng.randint(4, 7)
        graphs.append([(a, b, g) for a in range(n) for b in range(n) if a != b for g in (0, 1) if rng.random() < 0.22])
    edges, queries = [], []
    for i, own in enumerate(graphs):
        base = 20 * i
        edges += [(a + base, b + base, g) for a, b, g in own]
        ends = sorted({x for a, b, _ in own for x in (a, b)})
        queries += [(a + base, b + base, sigma) for a in ends for b in ends for sigma in (0, 1) if rng.random() < 0.35 or (a, b) in ((0, 8), (0, 4), (0, 1))]
    queries += [(0, 10**9, 1), (-5, 1, 1), (10**9, 10**9, 1), (19, 19, 1), (19, 19, -1)]
    return edges, [(i, *q) for i, q in enumerate(queries)]


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("k", [7])
def test_every_strategy_follows_the_definition(spark, strategy, k):
    edges, queries = _world()
    n = max(max(a, b) for a, b, _ in edges) + 1
    e = spark.createDataFrame(edges, "src long, dst long, sgn int")
    q = spark.createDataFrame(queries, "qid long, s long, t long, sigma int")
    got = {r.qid: r.result for r in reach(e, q, k, strategy).collect()}
    want = {i: -1 if strategy == "balanced" and sigma != 1 else answer(edges, s, t, sigma, k, n) for i, s, t, sigma in queries}
    assert {i: (got.get(i), w) for i, w in want.items() if got.get(i) != w} == {}


@pytest.mark.parametrize("k", [-1, 0, 1, 2])
def test_small_hop_bounds(spark, k):
    edges, asked = FIXTURES["F6"]
    e = spark.createDataFrame(edges, "src long, dst long, sgn int")
    q = spark.createDataFrame([(0, 0, 2, 1), (1, 0, 1, 1), (2, 1, 1, 1)], "qid long, s long, t long, sigma int")
    for strategy in ("bidirectional", "cascade", "two_sided", "automaton", "balanced"):
        got = {r.qid: r.result for r in reach(e, q, k, strategy).collect()}
        assert got == {0: int(k >= 2), 1: int(k >= 1), 2: 1}


def test_summaries(spark):
    edges, _ = FIXTURES["F2"]
    e = spark.createDataFrame(edges, "src long, dst long, sgn int")
    q = spark.createDataFrame([(0, 0, 4, 0), (1, 0, 4, 1), (2, 4, 0, 1)], "qid long, s long, t long, sigma int")
    r = reach(e, q, 6, "cascade")
    assert {(x.stage, x.result): x.queries for x in histogram(r).collect()} == {(-3, 0): 1, (2, 1): 1, (-2, 0): 1}
    row = summary(e, r, 6, "cascade").first()
    assert (row.queries, row.yes, row.no, row.edges) == (3, 1, 2, 5)


def test_flipping_all_signs_flips_odd_lengths():
    rng = random.Random(1)
    edges = [(a, b, g) for a in range(6) for b in range(6) if a != b for g in (0, 1) if rng.random() < 0.2]
    flipped = [(a, b, 1 - g) for a, b, g in edges]
    for t in range(1, 6):
        assert sorted(simple_paths(edges, 0, t, 5)) == sorted((p if n % 2 == 0 else 1 - p, n) for p, n in simple_paths(flipped, 0, t, 5))
