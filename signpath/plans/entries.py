"""Registered queries on derived graphs, and the SQL that they are compared with."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signpath.durable import shared_dir, stored
from signpath.operators import components, graph, kernels, labels, paths, walks
from signpath.sources import text

from . import derived
from .reach import blocks_per_query, exact_cases, histogram, reach, steps, summary

#: (strategy, hop bound) of the registered reachability queries.
REACH = [("exhaustive", 2), ("exhaustive", 4), ("exhaustive", 6), ("bidirectional", 6), ("distance_pruned", 6), ("two_sided", 6), ("automaton", 6), ("cascade", 6), ("cut_cascade", 6), ("cut_pruned", 5), ("local", 6), ("branch_and_bound", 6), ("components", 6), ("labels", 4), ("balanced", 5), ("cascade", 8)]


#: (strategy, hop bound) also registered over the workload whose walks go round circuits; at 9 hops one query in nine needs exact search.
BENT = [("exhaustive", 6), ("distance_pruned", 6), ("components", 6), ("cascade", 9), ("cut_cascade", 9)]


def _edge_sql(where: str = "WHERE o_orderpriority = '1-URGENT'") -> str:
    return f"""e AS (SELECT DISTINCT src, dst, sgn FROM (SELECT CAST(o_custkey AS BIGINT) AS src, CAST(lead(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS dst,
      CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS sgn FROM orders {where}) WHERE dst IS NOT NULL AND src <> dst)"""


_NEAR = "q AS (SELECT CAST(row_number() OVER (ORDER BY src, dst, 1 - sgn) AS BIGINT) AS qid, src AS s, dst AS t, CAST(1 - sgn AS INTEGER) AS sigma FROM e WHERE (src * 7 + dst) % 20 = 1)"
_FAR = """q AS (SELECT CAST(row_number() OVER (ORDER BY s) AS BIGINT) AS qid, * FROM (SELECT CAST(c_custkey AS BIGINT) AS s,
  CAST((c_custkey * 37 + 11) % (SELECT count(*) FROM customer) AS BIGINT) AS t, CAST(c_custkey % 2 AS INTEGER) AS sigma FROM customer WHERE c_custkey % 30 = 1) WHERE s <> t)"""


_BENT = """b AS (SELECT a.src AS s, a.dst AS m, a.sgn AS g, min({'t': o.dst, 'g': o.sgn}) AS x FROM e a JOIN e o ON a.dst = o.src AND o.dst <> a.src GROUP BY ALL),
  q AS (SELECT CAST(row_number() OVER (ORDER BY s, m, g) AS BIGINT) AS qid, s, x.t AS t, CAST(CASE WHEN g = x.g THEN 0 ELSE 1 END AS INTEGER) AS sigma FROM b)"""


def _paths_sql(k: int) -> str:
    return f"""p(qid, s, t, sigma, v, par, len, path) AS (SELECT qid, s, t, sigma, s, 1, 0, [s] FROM q UNION ALL
      SELECT p.qid, p.s, p.t, p.sigma, e.dst, CASE WHEN p.par = e.sgn THEN 1 ELSE 0 END, p.len + 1, list_append(p.path, e.dst)
      FROM p JOIN e ON e.src = p.v WHERE p.len < {k} AND p.v <> p.t AND NOT list_contains(p.path, e.dst))"""


def _reach_sql(k: int, balanced: bool = False, workload: str = _NEAR) -> str:
    asked = "CASE WHEN q.sigma <> 1 THEN -1 ELSE max(CASE WHEN p.v = p.t AND p.par = p.sigma THEN 1 ELSE 0 END) END" if balanced else "max(CASE WHEN p.v = p.t AND p.par = p.sigma THEN 1 ELSE 0 END)"
    return f"WITH RECURSIVE {_edge_sql()}, {workload}, {_paths_sql(k)} SELECT q.qid, q.s, q.t, q.sigma, CAST({asked} AS INTEGER) AS result FROM q JOIN p USING (qid) GROUP BY q.qid, q.s, q.t, q.sigma"


def _staged_sql(k: int, workload: str) -> str:
    """r (qid, s, t, sigma, result, stage): least shortest witnesses level by level, and enumeration for what they leave open."""
    levels = ["w0 AS MATERIALIZED (SELECT qid, s, t, sigma, s AS v, 1 AS par, [s] AS path FROM q)"]
    for i in range(k):
        seen = " UNION ALL ".join(f"SELECT qid, v, par FROM w{j}" for j in range(i + 1))
        levels.append(f"""w{i + 1} AS MATERIALIZED (SELECT n.* FROM (SELECT w.qid, w.s, w.t, w.sigma, e.dst AS v, CASE WHEN w.par = e.sgn THEN 1 ELSE 0 END AS par, min(list_append(w.path, e.dst)) AS path
          FROM w{i} w JOIN e ON e.src = w.v WHERE w.v <> w.t AND e.dst <> w.s GROUP BY ALL) n ANTI JOIN ({seen}) o ON n.qid = o.qid AND n.v = o.v AND n.par = o.par)""")
    hits = " UNION ALL ".join(f"SELECT qid, path FROM w{i} WHERE v = t AND par = sigma" for i in range(1, k + 1))
    return f"""WITH RECURSIVE {_edge_sql()}, {workload}, {", ".join(levels)}, h AS ({hits}), {_paths_sql(k)},
      x AS (SELECT qid, CAST(max(CASE WHEN v = t AND par = sigma THEN 1 ELSE 0 END) AS INTEGER) AS result FROM p GROUP BY qid),
      r AS (SELECT q.qid, q.s, q.t, q.sigma, x.result, CAST(CASE WHEN h.path IS NULL THEN -2 WHEN len(list_distinct(h.path)) = len(h.path) THEN 2 WHEN x.result = 1 THEN 3 ELSE -3 END AS INTEGER) AS stage
        FROM q JOIN x USING (qid) LEFT JOIN h USING (qid))"""


def _walks_sql(anchor: str, k: int, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"""w(anchor, v, par, len) AS (SELECT DISTINCT {anchor}, {anchor}, 1, 0 FROM q UNION
      SELECT w.anchor, e.{b}, CASE WHEN w.par = e.sgn THEN 1 ELSE 0 END, w.len + 1 FROM w JOIN e ON e.{a} = w.v WHERE w.len < {k})"""


def _loaded(spark: SparkSession, sf_dir: str, urgent: bool = True) -> tuple[DataFrame, DataFrame]:
    """Urgent orders and one edge in twenty, or all orders and every edge."""
    edges = derived.customer_graph(spark, sf_dir, urgent)
    return edges, derived.near(edges, whole=not urgent)


def _reach(strategy: str, k: int):
    def run(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
        return reach(*_loaded(spark, sf_dir, urgent), k, strategy).drop("stage")

    return run


def _reach_bent(spark: SparkSession, sf_dir: str, strategy: str, k: int) -> DataFrame:
    return reach(*_bent(spark, sf_dir), k, strategy).drop("stage")


def graph_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines through the text reader's rules."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = li.select(F.concat_ws("\t", F.col("l_partkey") - 20, "l_suppkey", F.col("l_linenumber") - 3, "l_returnflag").alias("value"))
    return text.parse_edges(lines)


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(derived.customer_graph(spark, sf_dir, urgent=False))


def degree_rank(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    return graph.ranked(derived.customer_graph(spark, sf_dir, urgent))


def csr_offsets(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    return graph.offsets(derived.customer_graph(spark, sf_dir, urgent))


def sign_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sign_balance(derived.user_graph(spark, sf_dir))


def walk_dist_from(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    e, q = _loaded(spark, sf_dir, urgent)
    return walks.signed_distances(e, q.select(F.col("s").alias("anchor")), 6)


def walk_dist_to(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    e, q = _loaded(spark, sf_dir, urgent)
    return walks.signed_distances(e, q.select(F.col("t").alias("anchor")), 6, backward=True)


def walk_reach_k6(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    return walks.walk_reach(*_loaded(spark, sf_dir, urgent), 6)


def dfa_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.parity_hop_dfa(spark, 6)


def reach_far_k6(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    return reach(derived.customer_graph(spark, sf_dir, urgent), derived.far(spark, sf_dir, whole=not urgent), 6, "cascade").drop("stage")


def trivial_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _loaded(spark, sf_dir)
    odd = q.select("qid", "s", F.when(F.col("qid") % 3 == 0, F.col("s")).when(F.col("qid") % 3 == 1, F.col("t") + 1_000_000_000).otherwise(F.col("t")).alias("t"), "sigma")
    return reach(e, odd, 3, "distance_pruned").drop("stage")


def shortest_signed_len(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    return paths.shortest_lengths(*_loaded(spark, sf_dir, urgent), 6)


def path_count_by_sign(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    return paths.counts_by_sign(*_loaded(spark, sf_dir, urgent), 5)


def query_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _loaded(spark, sf_dir)
    return reach(e, stored(text.shard(q, 5, 20), "shard"), 4, "exhaustive").drop("stage")


def run_summary(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    e, q = _loaded(spark, sf_dir, urgent)
    return summary(e, reach(e, q, 6, "cascade"), 6, "cascade")


def _bent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = derived.customer_graph(spark, sf_dir)
    return edges, derived.bent(edges)


def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(reach(*_bent(spark, sf_dir), 9, "cascade"))


def exact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_cases(reach(*_bent(spark, sf_dir), 9, "cut_cascade"))


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(*_loaded(spark, sf_dir), 6, "exhaustive")


def blocks_per_query_k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_per_query(*_loaded(spark, sf_dir), 6)


def strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines of four numbers among comments and lines of five."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    more = F.when(F.col("l_linenumber") == 7, F.lit("7"))
    line = F.concat_ws(" ", F.when(F.col("l_returnflag") == "R", F.lit("#")), "l_partkey", "l_suppkey", F.col("l_linenumber") - 3, "l_orderkey", more)
    return text.parse_edges_strict(li.select(line.alias("value")))


def query_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query file with malformed lines, written and read by its line numbers."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy("c_custkey").coalesce(1)
    line = F.when(F.col("c_custkey") % 10 == 3, F.lit("no query")).otherwise(F.concat_ws(",", "c_custkey", "c_nationkey", F.col("c_custkey") % 3 - 1))
    path = f"{shared_dir(spark).rstrip('/')}/query-file-{uuid.uuid4().hex}"
    customers.select(line.alias("value")).write.text(path)
    return text.read_queries(spark, path)


def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as CSV and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    for _ in range(2):
        text.write_results(reach(*_loaded(spark, sf_dir), 4, "bidirectional"), path, 4)
    return spark.read.schema("s long, t long, sigma int, result int").csv(f"{path}/k=4")


def summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of two runs, appended and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/summaries-{uuid.uuid4().hex}"
    e, q = _loaded(spark, sf_dir)
    for k in (2, 4):
        text.append_summary(summary(e, reach(e, q, k, "exhaustive"), k, "exhaustive").select("strategy", "k", "queries", "yes"), path)
    return spark.read.schema("strategy string, k int, queries long, yes long").json(path)


def scc(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    return components.strong_components(derived.customer_graph(spark, sf_dir, urgent))


def condensation_levels(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    e = derived.customer_graph(spark, sf_dir, urgent)
    return components.topological_levels(e, components.strong_components(e))


def biconnected_blocks(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    e = derived.customer_graph(spark, sf_dir, urgent)
    return kernels.biconnected_blocks(e, components.strong_components(e))


def two_hop_label_stats(spark: SparkSession, sf_dir: str, urgent: bool = True) -> DataFrame:
    return labels.label_stats(labels.build(derived.customer_graph(spark, sf_dir, urgent), 3))


_PLAIN = [graph_normalize, graph_stats, degree_rank, csr_offsets, sign_balance, walk_dist_from, walk_dist_to, walk_reach_k6, dfa_table, reach_far_k6, trivial_and_missing, shortest_signed_len, path_count_by_sign, query_shard, run_summary, outcome_histogram, exact_listing, run_steps, blocks_per_query_k6, strict_scan, query_file_scan, result_sink, summary_sink, scc, condensation_levels, biconnected_blocks, two_hop_label_stats]


#: What is also registered over all orders, with every edge (or every customer) as a query.
_WHOLE = [degree_rank, csr_offsets, walk_dist_from, walk_dist_to, walk_reach_k6, reach_far_k6, shortest_signed_len, path_count_by_sign, run_summary, scc, condensation_levels, biconnected_blocks, two_hop_label_stats]


def queries() -> dict:
    searches = {f"reach_{s}_k{k}": _reach(s, k) for s, k in REACH}
    bent = {f"reach_bent_{s}_k{k}": partial(_reach_bent, strategy=s, k=k) for s, k in BENT}
    whole = {f.__name__: f for f in _WHOLE} | searches
    return {f.__name__: f for f in _PLAIN} | searches | bent | {f"{name}_whole": partial(f, urgent=False) for name, f in whole.items()}


def oracle_sql() -> dict[str, str]:
    e, full = _edge_sql(), _edge_sql("")
    degree = "d AS (SELECT v, CAST(sum(o) AS BIGINT) AS d_out, CAST(sum(i) AS BIGINT) AS d_in FROM (SELECT src AS v, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY v)"
    yes = "max(CASE WHEN p.v = p.t AND p.par = p.sigma THEN 1 ELSE 0 END)"
    reachable = "r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), vs AS (SELECT src AS v FROM e UNION SELECT dst FROM e), c AS (SELECT v, least(v, coalesce(min(x.b), v)) AS comp FROM vs LEFT JOIN (SELECT r.a, r.b FROM r JOIN r AS r2 ON r.a = r2.b AND r.b = r2.a) x ON x.a = v GROUP BY v)"
    out = {f"reach_{s}_k{k}": _reach_sql(k, s == "balanced") for s, k in REACH} | {f"reach_bent_{s}_k{k}": _reach_sql(k, workload=_BENT) for s, k in BENT}
    return out | {
        "graph_normalize": "SELECT DISTINCT CAST(l_partkey - 20 AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst, CASE WHEN l_linenumber - 3 > 0 THEN 1 ELSE 0 END AS sgn FROM lineitem WHERE l_partkey - 20 >= 0 AND l_suppkey >= 0 AND l_partkey - 20 <> l_suppkey",
        "graph_stats": f"WITH {full} SELECT CAST(max(greatest(src, dst)) + 1 AS BIGINT) AS n, count(*) AS m, count(*) FILTER (sgn = 1) AS positive, count(*) FILTER (sgn = 0) AS negative, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e",
        "degree_rank": f"WITH {e}, {degree} SELECT v, d_out, d_in, row_number() OVER (ORDER BY d_in * d_out DESC, v) AS rank FROM d",
        "csr_offsets": f"WITH {e}, {degree}, f AS (SELECT v, d_out, CAST(sum(d_out) OVER (ORDER BY v) AS BIGINT) AS finish FROM d) SELECT v, finish - d_out AS begin, finish FROM f",
        "sign_balance": "WITH e AS (SELECT DISTINCT src, dst, sgn FROM (SELECT CAST(user_id AS BIGINT) AS src, CAST(lead(user_id) OVER (ORDER BY ts, event_id) AS BIGINT) AS dst, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS sgn FROM events) WHERE dst IS NOT NULL AND src <> dst), p AS (SELECT src, dst, count(*) FILTER (sgn = 1) AS p, count(*) FILTER (sgn = 0) AS q FROM e GROUP BY src, dst) SELECT src AS v, CAST(sum(p) AS BIGINT) AS positive, CAST(sum(q) AS BIGINT) AS negative, count(*) FILTER (p > 0 AND q > 0) AS mixed FROM p GROUP BY src",
        "walk_dist_from": f"WITH RECURSIVE {e}, {_NEAR}, {_walks_sql('s', 6)} SELECT anchor, v, par, CAST(min(len) AS INTEGER) AS dist FROM w GROUP BY anchor, v, par",
        "walk_dist_to": f"WITH RECURSIVE {e}, {_NEAR}, {_walks_sql('t', 6, True)} SELECT anchor, v, par, CAST(min(len) AS INTEGER) AS dist FROM w GROUP BY anchor, v, par",
        "walk_reach_k6": f"WITH RECURSIVE {e}, {_NEAR}, {_walks_sql('s', 6)} SELECT qid, CAST(max(CASE WHEN w.v = q.t AND w.par = q.sigma THEN 1 ELSE 0 END) AS INTEGER) AS walk FROM q JOIN w ON w.anchor = q.s GROUP BY qid",
        "dfa_table": "SELECT CAST(s AS INTEGER) AS state, CAST(l AS INTEGER) AS label, CAST((s // 2 + 1) * 2 + CASE WHEN l = 1 THEN s % 2 ELSE 1 - s % 2 END AS INTEGER) AS next FROM range(12) a(s), range(2) b(l)",
        "reach_far_k6": _reach_sql(6, workload=_FAR),
        "trivial_and_missing": f"WITH RECURSIVE {e}, {_NEAR.replace('q AS', 'q0 AS', 1)}, q AS (SELECT qid, s, CASE qid % 3 WHEN 0 THEN s WHEN 1 THEN t + 1000000000 ELSE t END AS t, sigma FROM q0), {_paths_sql(3)} SELECT q.qid, q.s, q.t, q.sigma, CAST({yes} AS INTEGER) AS result FROM q JOIN p USING (qid) GROUP BY ALL",
        "shortest_signed_len": f"WITH RECURSIVE {e}, {_NEAR}, {_paths_sql(6)} SELECT qid, par, CAST(min(len) AS INTEGER) AS len FROM p WHERE v = t GROUP BY qid, par",
        "path_count_by_sign": f"WITH RECURSIVE {e}, {_NEAR}, {_paths_sql(5)} SELECT qid, len, par, count(*) AS paths FROM p WHERE v = t GROUP BY qid, len, par",
        "query_shard": f"WITH RECURSIVE {e}, {_NEAR.replace('q AS', 'q0 AS', 1)}, q AS (SELECT * FROM q0 ORDER BY qid LIMIT 20 OFFSET 5), {_paths_sql(4)} SELECT q.qid, q.s, q.t, q.sigma, CAST({yes} AS INTEGER) AS result FROM q JOIN p USING (qid) GROUP BY ALL",
        "run_summary": f"{_staged_sql(6, _NEAR)} SELECT 'cascade' AS strategy, CAST(6 AS INTEGER) AS k, (SELECT count(*) FROM e) AS edges, count(*) AS queries, count(*) FILTER (result = 1) AS yes, count(*) FILTER (result = 0) AS no, CAST(0 AS BIGINT) AS not_asked, count(*) FILTER (stage = 2) AS by_witness, count(*) FILTER (stage = -2) AS no_walk, count(*) FILTER (abs(stage) = 3) AS exact FROM r",
        "outcome_histogram": f"{_staged_sql(9, _BENT)} SELECT stage, sigma, result, count(*) AS queries FROM r GROUP BY ALL",
        "exact_listing": f"{_staged_sql(9, _BENT)} SELECT * FROM r WHERE abs(stage) = 3",
        "run_steps": f"WITH RECURSIVE {e}, {_NEAR}, {_paths_sql(6)}, f AS (SELECT qid, min(len) AS upto FROM p WHERE v = t AND par = sigma GROUP BY qid) SELECT 'paths' AS step, CAST(len AS INTEGER) AS level, count(*) AS rows, count(*) FILTER (v = t AND par = sigma) AS hits FROM p LEFT JOIN f USING (qid) WHERE len BETWEEN 1 AND coalesce(upto, 6) GROUP BY len",
        "strict_scan": "SELECT DISTINCT CAST(l_partkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst, CASE WHEN l_linenumber - 3 > 0 THEN 1 ELSE 0 END AS sgn FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 7 AND l_partkey <> l_suppkey",
        "query_file_scan": "SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS qid, CAST(c_custkey AS BIGINT) AS s, CAST(c_nationkey AS BIGINT) AS t, CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END AS sigma FROM customer) WHERE s % 10 <> 3",
        "result_sink": f"SELECT s, t, sigma, result FROM ({_reach_sql(4)})",
        "summary_sink": " UNION ALL ".join(f"SELECT 'exhaustive' AS strategy, CAST({k} AS INTEGER) AS k, count(*) AS queries, count(*) FILTER (result = 1) AS yes FROM ({_reach_sql(k)})" for k in (2, 4)),
        "scc": f"WITH RECURSIVE {e}, {reachable} SELECT v, CAST(comp AS BIGINT) AS comp FROM c",
        "condensation_levels": f"WITH RECURSIVE {e}, {reachable}, a AS (SELECT DISTINCT x.comp AS s, y.comp AS d FROM e JOIN c x ON x.v = e.src JOIN c y ON y.v = e.dst WHERE x.comp <> y.comp), l(comp, level) AS (SELECT DISTINCT comp, 0 FROM c UNION SELECT a.d, l.level + 1 FROM l JOIN a ON a.s = l.comp) SELECT CAST(comp AS BIGINT) AS comp, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY comp",
    }
