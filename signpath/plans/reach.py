"""Batches of reachability queries.

Semantics, whatever the strategy: a query (s, t, sigma) is true if a path without repeated vertices leads from s to t over at
most k edges with sign product sigma (1 positive, all else negative). s = t is true for sigma = 1 only. Vertices
outside 0 .. n - 1 make a query false. k below 0 counts as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpath.durable import stored, tallied
from signpath.operators import balanced, cascade, components, intask, kernels, labels, paths
from signpath.operators.graph import vertex_count

_found = {
    "exhaustive": paths.exhaustive,
    "distance_pruned": paths.distance_pruned,
    "two_sided": paths.two_sided,
    "bidirectional": paths.bidirectional,
    "automaton": paths.automaton,
    "cut_pruned": cascade.cut_pruned,
    "local": kernels.local_search,
    "branch_and_bound": lambda e, q, k: kernels.branch_and_bound(e, q, k).select("qid"),
    "components": lambda e, q, k: components.by_component(e, q, k).where("len is not null").select("qid"),
}
_staged = {"cascade": cascade.staged, "cut_cascade": cascade.staged_by_cuts, "labels": labels.staged_by_labels}
STRATEGIES = [*_found, *_staged, "balanced"]


def classified(queries: DataFrame, n: int) -> DataFrame:
    """Adds ``decided``: 0 or 1 for queries that need no search, else null. sigma is normalised."""
    q = queries.withColumn("sigma", F.when(F.col("sigma") == 1, 1).otherwise(0).cast("int"))
    inside = F.col("s").between(0, n - 1) & F.col("t").between(0, n - 1)
    return q.withColumn("decided", F.when(~inside, 0).when(F.col("s") == F.col("t"), F.col("sigma")))


def reach(edges: DataFrame, queries: DataFrame, k: int, strategy: str = "cascade") -> DataFrame:
    """(qid, s, t, sigma, result, stage) of every query.

    result is 1, 0, or for strategy ``balanced`` -1 where sigma isn't positive. stage is the outcome code of staged
    strategies, 0 for queries decided without a search, and null elsewhere.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    k = max(k, 0)
    q = classified(queries if hasattr(queries, "_stored_at") else stored(queries, "queries"), vertex_count(edges))
    asks = F.col("decided").isNull() & (F.lit(strategy != "balanced") | (F.col("sigma") == 1))
    open_ = q.where("decided is null").drop("decided")
    hit = None
    if strategy in intask.BY_QUERY and intask.fits(edges, k) or strategy in intask.KERNELS and intask.fits(edges, k, whole=intask.KERNELS[strategy] is intask.halves):
        searched = intask.found(edges, q.where(asks).drop("decided"), k, strategy).withColumn("decided", F.lit(None).cast("int"))
        out = searched.unionByName(q.where(~asks).withColumn("stage", F.lit(None).cast("int")).select(*searched.columns))
    elif strategy == "balanced":
        hit = balanced.balanced_search(edges, open_.where("sigma = 1"), k).withColumn("stage", F.lit(1))
    elif strategy in _found:
        hit = (_found[strategy](edges, open_, k) if k else open_.select("qid").limit(0)).withColumn("stage", F.lit(1))
    else:
        hit = _staged[strategy](edges, open_, k) if k else open_.select("qid", F.lit(-2).alias("stage"))
    if hit is not None:
        out = q.join(hit, "qid", "left")
    result = F.when(F.lit(strategy == "balanced") & (F.col("sigma") != 1), -1).when(F.col("decided").isNotNull(), F.col("decided")).otherwise(F.coalesce((F.col("stage") > 0).cast("int"), F.lit(0)))
    stage = F.when(F.col("decided").isNotNull(), 0).when(F.lit(strategy in _staged), F.col("stage"))
    return out.select("qid", "s", "t", "sigma", result.cast("int").alias("result"), stage.cast("int").alias("stage"))


def histogram(results: DataFrame) -> DataFrame:
    """(stage, sigma, result, queries)."""
    return results.groupBy("stage", "sigma", "result").agg(F.count("*").alias("queries"))


def exact_cases(results: DataFrame) -> DataFrame:
    """Queries that needed exact search."""
    return results.where("abs(stage) = 3")


def steps(edges: DataFrame, queries: DataFrame, k: int, strategy: str) -> DataFrame:
    """(step, level, rows, hits): what each level of a run wrote, observed as it was written."""
    with tallied() as tally:
        reach(edges, queries, k, strategy).write.format("noop").mode("overwrite").save()
    told = [(x["table"], x["level"], x["rows"], x.get("hits")) for x in tally if x["rows"] and x["level"]]
    return edges.sparkSession.createDataFrame(told, "step string, level int, rows long, hits long")


def blocks_per_query(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: queries that were searched by blocks, their mean and greatest number of blocks."""
    found = components.by_component(edges, queries, k)
    return found.agg(F.count("*").alias("queries"), F.round(F.avg("blocks"), 6).alias("mean_blocks"), F.max("blocks").alias("most_blocks"))


def summary(edges: DataFrame, results: DataFrame, k: int, strategy: str) -> DataFrame:
    """One row: the run's counts, in all and by outcome; ``exact`` are queries that needed exact search."""
    return results.agg(F.lit(strategy).alias("strategy"), F.lit(k).alias("k"), F.lit(edges.count()).cast("bigint").alias("edges"), F.count("*").alias("queries"), F.count_if(F.col("result") == 1).alias("yes"), F.count_if(F.col("result") == 0).alias("no"), F.count_if(F.col("result") == -1).alias("not_asked"), F.count_if(F.col("stage") == 2).alias("by_witness"), F.count_if(F.col("stage") == -2).alias("no_walk"), F.count_if(F.abs("stage") == 3).alias("exact"))
