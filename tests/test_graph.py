from signpath.operators import components, graph, kernels, labels, paths, walks
from signpath.operators.cascade import cut_sets
from signpath.sources import text
from signpath.streaming.queries import answer_stream

from .brute import answer

RAW = ["0 1 1", "0\t1\t5", "1,2,0", "1 2 -3 99", "1 2 1", "3 3 1", "-1 2 1", "# comment", "1 2", ""]
EDGES = "src long, dst long, sgn int"


def test_reader_rules(spark):
    got = text.parse_edges(spark.createDataFrame([(x,) for x in RAW], "value string"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1), (1, 2, 0), (1, 2, 1)]
    assert graph.vertex_count(got) == 3
    assert graph.vertex_count(got.limit(0)) == 0


def test_strict_reader_takes_one_arity(spark):
    lines = spark.createDataFrame([("0 1 1",), ("1 2 0",), ("1 2 1 99",), ("x 1 1",)], "value string")
    assert text.infer_arity(lines) == 3
    assert sorted(map(tuple, text.parse_edges_strict(lines).collect())) == [(0, 1, 1), (1, 2, 0)]


def test_query_files_results_and_shards(spark, tmp_path):
    (tmp_path / "q.txt").write_text("0,1,1\nbad\n2,3,0\n2,3,0\n4,5,-1\n")
    q = text.read_queries(spark, str(tmp_path / "q.txt"))
    assert sorted(map(tuple, q.collect())) == [(0, 0, 1, 1), (2, 2, 3, 0), (3, 2, 3, 0), (4, 4, 5, 0)]
    assert [r.qid for r in text.shard(q, 1, 2).collect()] == [2, 3]
    assert text.read_queries(spark, str(tmp_path / "q.txt"), first=3).count() == 2
    text.write_results(q.selectExpr("*", "1 AS result"), str(tmp_path / "out"), 4)
    assert spark.read.csv(str(tmp_path / "out")).count() == 4
    (tmp_path / "g.txt").write_text("\n".join(RAW))
    assert text.read_edges(spark, str(tmp_path / "g.txt")).count() == 3


def test_statistics(spark):
    e = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 2, 1), (2, 0, 0)], EDGES)
    assert tuple(graph.stats(e).first()) == (3, 4, 2, 2, 3, 3)
    assert sorted(map(tuple, graph.offsets(e).collect())) == [(0, 0, 2), (1, 2, 3), (2, 3, 4)]
    assert {r.v: r["rank"] for r in graph.ranked(e).collect()} == {0: 1, 1: 2, 2: 3}
    assert sorted(map(tuple, graph.sign_balance(e).collect())) == [(0, 1, 1, 1), (1, 1, 0, 0), (2, 0, 1, 0)]
    assert graph.adjacency(e).where("v = 0").first().out == [(1, 0), (1, 1)]


def test_components_levels_and_blocks(spark):
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 0), (3, 4, 1), (4, 3, 1), (4, 5, 1), (6, 0, 1)], EDGES)
    comp = components.strong_components(e)
    assert dict(map(tuple, comp.collect())) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    assert dict(map(tuple, components.topological_levels(e, comp).collect())) == {6: 0, 0: 1, 3: 2, 5: 3}
    assert kernels.blocks_of([(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (3, 4), (4, 5)]) == [0, 0, 0, 3, 3, 3, 6]


def test_cuts_hold_what_all_walks_pass(spark):
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (1, 3, 1), (2, 4, 1), (3, 4, 1), (4, 5, 1)], EDGES)
    q = spark.createDataFrame([(0, 0, 5, 1)], "qid long, s long, t long, sigma int")
    got = {r.v: r.cut for r in cut_sets(e, q, 4).where("level = 4").collect()}
    assert got[5] == [1, 4, 5] and got[4] == [1, 4] and got[2] == [1, 2]


def test_labels_are_walk_distances(spark):
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 0), (2, 0, 1), (1, 3, 1), (3, 2, 1)], EDGES)
    built = labels.build(e, 4, batches=(1, 2))
    dist = {tuple(r)[:3]: r.dist for r in walks.signed_distances(e, spark.createDataFrame([(v,) for v in range(4)], "anchor long"), 4).collect()}
    rows = built.collect()
    assert rows
    for r in rows:
        key = (r.hub, r.v, r.par) if r.side == "in" else (r.v, r.hub, r.par)
        assert dist[key] <= r.dist and len(r.path) == r.dist + 1


def test_shortest_simple_by_branching():
    circle = [(0, 1, 1), (1, 2, 1), (2, 3, 0), (3, 1, 1), (1, 4, 1)]
    assert kernels.shortest_simple(circle, 0, 4, 1, 6) == 2
    assert kernels.shortest_simple(circle, 0, 4, 0, 8) is None


def test_automaton_counts_hops_and_parity(spark):
    steps = {(r.state, r.label): r.next for r in walks.parity_hop_dfa(spark, 2).collect()}
    assert steps == {(0, 1): 2, (0, 0): 3, (1, 1): 3, (1, 0): 2, (2, 1): 4, (2, 0): 5, (3, 1): 5, (3, 0): 4}


def test_counts_and_lengths(spark):
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 0), (0, 2, 0), (0, 2, 1)], EDGES)
    q = spark.createDataFrame([(7, 0, 2, 1)], "qid long, s long, t long, sigma int")
    assert sorted(map(tuple, paths.counts_by_sign(e, q, 3).collect())) == [(7, 1, 0, 1), (7, 1, 1, 1), (7, 2, 0, 1)]
    assert sorted(map(tuple, paths.shortest_lengths(e, q, 3).collect())) == [(7, 0, 1), (7, 1, 1)]


def test_queries_as_a_stream(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 0)], EDGES)
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, 0, 2, 0), (1, 0, 2, 1)], "qid long, s long, t long, sigma int").write.parquet(src)
    stream = spark.readStream.schema("qid long, s long, t long, sigma int").parquet(src)
    answer_stream(e, stream, 3, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.qid, r.result) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 1), (1, 0)]


def test_whole_graph_queries_leave_no_order_out(spark, tmp_path):
    from signpath.plans import entries

    walk = [1, 2, 3, 1, 4, 5, 6, 4, 2, 6, 7]
    orders = [(i, v, "FOP"[i % 3], float(i), ("1-URGENT", "3-MEDIUM", "5-LOW")[i % 2 + i % 3 // 2]) for i, v in enumerate(walk)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    edges = sorted({(a[1], b[1], int(a[2] != "F")) for a, b in zip(orders, orders[1:])})
    asked = sorted((a, b, 1 - g) for a, b, g in edges)
    q, at = entries.queries(), str(tmp_path)
    assert {r.v: (r.d_out, r.d_in) for r in q["degree_rank_whole"](spark, at).collect()} == {v: (sum(e[0] == v for e in edges), sum(e[1] == v for e in edges)) for v in set(walk)}
    assert dict(map(tuple, q["scc_whole"](spark, at).collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7}
    for name in ("reach_cascade_k6_whole", "reach_two_sided_k6_whole"):
        got = sorted((r.s, r.t, r.sigma, r.result) for r in q[name](spark, at).collect())
        assert got == [(s, t, g, answer(edges, s, t, g, 6, 8)) for s, t, g in asked]
    assert {(r.edges, r.queries) for r in q["run_summary_whole"](spark, at).collect()} == {(len(edges), len(asked))}


def test_blocks_equal_a_plain_definition():
    """Two edges are in one block if no vertex parts them: they are joined when any one vertex is taken away, but for their own ends."""
    import random

    rng = random.Random(6)
    for _ in range(30):
        n = rng.randint(3, 8)
        pairs = sorted({(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.35})
        got = kernels.blocks_of(pairs)

        def together(i, j):
            """Whether some simple circuit goes through both edges (or they are the same)."""
            if i == j:
                return True
            (a, b), (c, d) = pairs[i], pairs[j]
            arcs = [(x, y, 1) for k, (x, y) in enumerate(pairs) if k != i] + [(y, x, 1) for k, (x, y) in enumerate(pairs) if k != i]

            def ways(v, path):
                if v == b:
                    yield path
                    return
                for x, y, _ in arcs:
                    if x == v and y not in path:
                        yield from ways(y, [*path, y])

            return any({c, d} in [{x, y} for x, y in zip(p, p[1:], strict=False)] for p in ways(a, [a]))

        for i in range(len(pairs)):
            for j in range(i):
                assert (got[i] == got[j]) == together(i, j), pairs


def test_a_large_block_takes_time_in_proportion():
    import time

    n, began = 40_000, time.process_time()
    assert set(kernels.blocks_of([(i, i + 1) for i in range(n - 1)] + [(0, n - 1)])) == {0}
    assert time.process_time() - began < 15


def test_search_by_blocks_equals_enumeration():
    import random

    from .brute import simple_paths

    rng = random.Random(7)
    for _ in range(150):
        n = rng.randint(2, 8)
        edges = [(a, b, g) for a in range(n) for b in range(n) if a != b for g in (0, 1) if rng.random() < 0.16]
        for sigma in (0, 1):
            sizes = [size for par, size in simple_paths(edges, 0, n - 1, 6) if par == sigma]
            assert kernels.shortest_by_blocks(edges, 0, n - 1, sigma, 6)[0] == min(sizes, default=None), edges


def test_blocks_of_a_chain(spark):
    edges = [(0, 1, 1), (1, 2, 1), (2, 0, 0), (1, 3, 0), (3, 4, 1), (4, 1, 1)]
    assert [(s, t) for _, s, t in kernels.block_chain(sorted({(min(a, b), max(a, b)) for a, b, _ in edges}), 0, 4)] == [(0, 1), (1, 4)]
    assert kernels.block_chain([(0, 1), (2, 3)], 0, 3) == []
    from signpath.plans.reach import blocks_per_query

    e, q = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(0, 0, 4, 1), (1, 2, 1, 0)], "qid long, s long, t long, sigma int")
    # No path goes on from its target, so that of the circuit 1, 3, 4 the edges 1 to 3 and 3 to 4 are left, each a block.
    assert blocks_per_query(e, q, 4).first().most_blocks == 3


def test_ranks_and_lines_do_not_depend_on_ranges(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = {r.v: r.sum for r in graph.running(rows, F.col("v"), [F.col("v")], "sum").collect()}
    total = 0
    for v in sorted(got):
        total += v
        assert got[v] == total
    (tmp_path / "q.txt").write_text("".join(f"{i},{i + 1},1\n" if i % 3 else "\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        q = text.read_queries(spark, str(tmp_path / "q.txt"))
        assert sorted((r.qid, r.s) for r in q.collect()) == [(i, i) for i in range(5000) if i % 3]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    import pytest

    from signpath.durable import shared_dir

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_steps_count_what_levels_wrote(spark):
    from signpath.plans.reach import steps

    e = spark.createDataFrame([(0, 1, 1), (1, 2, 0), (0, 2, 1), (2, 3, 1)], EDGES)
    q = spark.createDataFrame([(0, 0, 3, 0), (1, 0, 2, 1)], "qid long, s long, t long, sigma int")
    assert sorted(map(tuple, steps(e, q, 4, "exhaustive").collect())) == [("paths", 1, 4, 1), ("paths", 2, 2, 0), ("paths", 3, 1, 1)]
