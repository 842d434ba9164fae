"""Walks: distances by sign, reachability, and the product with a hop-and-parity automaton."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signpath.durable import counted, rows_of, stored
from signpath.functions.signs import product

from .graph import reverse, sized


def _levels(seed: DataFrame, step, keys: list[str], k: int, name: str) -> list[DataFrame]:
    """Frontiers 0..k: each is what ``step`` makes of the one before, without states seen earlier."""
    levels = [counted(seed, name)]
    for d in range(1, k + 1):
        seen = reduce(DataFrame.unionByName, [x.select(*keys) for x in levels])
        levels.append(counted(step(levels[-1], d).join(seen, keys, "left_anti"), name, d))
        if not rows_of(levels[-1]):
            break
    return levels


def _ball(seed: DataFrame, step, keys: list[str], k: int, name: str) -> DataFrame:
    """``keys`` and their least ``dist`` up to k, in one job: for half the hops of a search, where levels are small."""
    levels = [seed]
    for d in range(1, k + 1):
        levels.append(step(levels[-1], d))
    return stored(reduce(DataFrame.unionByName, levels).groupBy(*keys).agg(F.min("dist").alias("dist")), name)


def _signed(edges: DataFrame, anchors: DataFrame, backward: bool):
    e = sized(reverse(edges) if backward else edges)
    seed = anchors.select("anchor").distinct().select("anchor", F.col("anchor").alias("v"), F.lit(1).alias("par"), F.lit(0).alias("dist"))

    def step(frontier: DataFrame, d: int) -> DataFrame:
        met = frontier.join(e, F.col("v") == F.col("src"))
        return met.select("anchor", F.col("dst").alias("v"), product(F.col("par"), F.col("sgn")).alias("par"), F.lit(d).alias("dist")).distinct()

    return seed, step


def signed_distances(edges: DataFrame, anchors: DataFrame, k: int, backward: bool = False) -> DataFrame:
    """(anchor, v, par, dist): least length of a walk of sign par from the anchor to v, or from v to it, up to k.

    ``anchors`` has a column ``anchor``; work is shared by all queries that have the same one.
    """
    return reduce(DataFrame.unionByName, _levels(*_signed(edges, anchors, backward), ["anchor", "v", "par"], k, "walks"))


def signed_ball(edges: DataFrame, anchors: DataFrame, k: int, backward: bool = False) -> DataFrame:
    """``signed_distances`` for few hops, in one job."""
    return _ball(*_signed(edges, anchors, backward), ["anchor", "v", "par"], k, "signed-ball")


def _plain(edges: DataFrame, anchors: DataFrame, backward: bool, avoid: bool):
    e = sized((reverse(edges) if backward else edges).select("src", "dst").distinct())
    seed = anchors.select("qid", F.col("anchor").alias("v"), "other", F.lit(0).alias("dist"))

    def step(frontier: DataFrame, d: int) -> DataFrame:
        if avoid:
            frontier = frontier.where("v <> other")
        met = frontier.join(e, F.col("v") == F.col("src"))
        return met.select("qid", F.col("dst").alias("v"), "other", F.lit(d).alias("dist")).distinct()

    return seed, step


def distances(edges: DataFrame, anchors: DataFrame, k: int, backward: bool = False, avoid: bool = False) -> DataFrame:
    """(qid, v, dist) without signs; with ``avoid``, walks never pass through the query's other end (column ``other``)."""
    return reduce(DataFrame.unionByName, _levels(*_plain(edges, anchors, backward, avoid), ["qid", "v"], k, "hops")).select("qid", "v", "dist")


def ball(edges: DataFrame, anchors: DataFrame, k: int, backward: bool = False) -> DataFrame:
    """(qid, v, dist) for few hops, in one job; walks never pass through the query's other end."""
    return _ball(*_plain(edges, anchors, backward, True), ["qid", "v", "other"], k, "ball").drop("other")


def walk_reach(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, walk): whether a walk of at most k edges has the wanted sign. False rules a simple path out.

    Half of the hops are walked from each end, shared by all queries with that end, and met in the middle.
    """
    half = (k + 1) // 2
    ahead = signed_ball(edges, queries.select(F.col("s").alias("anchor")), half)
    back = signed_ball(edges, queries.select(F.col("t").alias("anchor")), k - half, backward=True)
    one = queries.join(ahead.select(F.col("anchor").alias("s"), "v", F.col("par").alias("p1"), F.col("dist").alias("d1")), "s").select("qid", "t", "v", product(F.col("p1"), F.col("sigma")).alias("p2"))
    hits = one.join(back.select(F.col("anchor").alias("t"), "v", F.col("par").alias("p2")), ["t", "v", "p2"]).select("qid").distinct()
    return queries.select("qid").join(hits.withColumn("walk", F.lit(1)), "qid", "left").select("qid", F.coalesce("walk", F.lit(0)).alias("walk"))


def parity_hop_dfa(spark: SparkSession, k: int) -> DataFrame:
    """(state, label, next) of the automaton that counts hops up to k and negative labels: state 2 * hops + negatives mod 2.

    Labels are signs (1 keeps the parity, 0 changes it). 4 k rows.
    """
    state = spark.range(2 * k).select(F.col("id").cast("int").alias("state"))
    labels = spark.range(2).select(F.col("id").cast("int").alias("label"))
    step = (F.floor(F.col("state") / 2) + 1) * 2 + F.when(F.col("label") == 1, F.col("state") % 2).otherwise(1 - F.col("state") % 2)
    return state.join(F.broadcast(labels)).select("state", "label", step.cast("int").alias("next"))


def final_states(sigma: DataFrame, k: int) -> DataFrame:
    """Adds to each row of ``sigma`` the states that accept it: its parity after 1 to k hops."""
    return sigma.withColumn("state", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("state", (F.col("state") * 2 + (1 - F.col("sigma"))).cast("int"))


def product_candidates(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(t, sigma, v, state): product states from which an accepting state at t can be reached."""
    dfa = F.broadcast(parity_hop_dfa(edges.sparkSession, k))
    e = sized(edges)
    seed = final_states(queries.select("t", "sigma").distinct(), k).select("t", "sigma", F.col("t").alias("v"), "state")

    def step(frontier: DataFrame, d: int) -> DataFrame:
        back = frontier.join(e, F.col("v") == F.col("dst")).select("t", "sigma", F.col("src").alias("v"), F.col("state").alias("next"), F.col("sgn").alias("label"))
        return back.join(dfa, ["next", "label"]).select("t", "sigma", "v", "state").distinct()

    return reduce(DataFrame.unionByName, _levels(seed, step, ["t", "sigma", "v", "state"], k, "product"))
