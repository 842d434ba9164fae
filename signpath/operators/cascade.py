"""Cheap tests first: walks with one witness a state, then exact search for what is left; and cut sets.

Outcome codes: 2 a witness is simple, -2 no walk of the sign exists, 3 and -3 decided by exact search (positive is true).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpath.durable import counted, rows_of, seen, stored
from signpath.functions.signs import intersect_keeping, is_simple, product, sorted_insert

from .graph import reverse, sized
from .paths import distance_pruned, expand, hopeful, start


def witnesses(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, path): for each query whose target and sign some walk reaches within k edges, the least shortest witness.

    Walks don't come back to s and don't go on from t; a state (vertex, sign) keeps one witness. States that can't reach the
    target in the hops that remain go, and so do all states of a query once it has its witness.
    """
    e, prune = sized(edges), hopeful(edges, queries, k)
    levels = [stored(start(queries), "witness")]
    found = []
    for d in range(1, k + 1):
        met = levels[-1].where("v <> t").join(e, F.col("v") == F.col("src")).where("dst <> s")
        new = met.select("qid", "s", "t", "sigma", F.col("dst").alias("v"), product(F.col("par"), F.col("sgn")).alias("par"), (F.col("len") + 1).alias("len"), F.concat("path", F.array("dst")).alias("path"))
        if found and found[-1] is levels[-1]:
            new = new.join(levels[-1].where("v = t and par = sigma").select("qid"), "qid", "left_anti")
        new = prune(new.groupBy("qid", "s", "t", "sigma", "v", "par", "len").agg(F.min("path").alias("path")), d)
        old = reduce(DataFrame.unionByName, [x.select("qid", "v", "par") for x in levels])
        levels.append(counted(new.join(old, ["qid", "v", "par"], "left_anti"), "witness", d, hits=F.count_if((F.col("v") == F.col("t")) & (F.col("par") == F.col("sigma")))))
        if seen(levels[-1])["hits"]:
            found.append(levels[-1])
        if not rows_of(levels[-1]):
            break
    hits = [x.where("v = t and par = sigma").select("qid", "path") for x in found]
    return reduce(DataFrame.unionByName, hits) if hits else levels[0].select("qid", "path").limit(0)


def staged(edges: DataFrame, queries: DataFrame, k: int, exact=distance_pruned) -> DataFrame:
    """(qid, stage) with the outcome code of every query."""
    found = counted(queries.select("qid").join(witnesses(edges, queries, k), "qid", "left").select("qid", F.when(F.col("path").isNull(), -2).when(is_simple(F.col("path")), 2).otherwise(0).alias("stage")), "cascade", open=F.count_if(F.col("stage") == 0))
    if not seen(found)["open"]:
        return found
    rest = stored(queries.join(found.where("stage = 0").select("qid"), "qid", "left_semi"), "undecided")
    yes = exact(edges, rest, k).withColumn("hit", F.lit(3))
    return found.where("stage <> 0").unionByName(rest.select("qid").join(yes, "qid", "left").select("qid", F.coalesce("hit", F.lit(-3)).alias("stage")))


def cut_sets(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, level, v, par, cut): vertices on every walk from s to (v, par) of at most ``level`` edges; v is among them, s is not.

    A walk isn't extended into its own cut. Intersections are made in two steps, partial ones within a partition.
    """
    e = sized(edges)
    now = stored(queries.select("qid", "s", "t", F.lit(0).alias("level"), F.col("s").alias("v"), F.lit(1).alias("par"), F.array().cast("array<bigint>").alias("cut")), "cuts")
    levels = [now]
    both = lambda items: F.aggregate(F.slice(items, 2, 2**30), F.get(items, 0), F.array_intersect)
    for d in range(1, k + 1):
        met = now.where("v <> t").join(e, F.col("v") == F.col("src")).where((F.col("dst") != F.col("s")) & ~F.array_contains("cut", F.col("dst")))
        new = met.select("qid", "s", "t", F.col("dst").alias("v"), product(F.col("par"), F.col("sgn")).alias("par"), sorted_insert(F.col("cut"), F.col("dst")).alias("cut"))
        new = new.unionByName(now.select("qid", "s", "t", "v", "par", "cut"))
        # Equal cuts count once, which bounds what is collected for a state.
        new = new.distinct().groupBy("qid", "s", "t", "v", "par").agg(F.sort_array(both(F.collect_list("cut"))).alias("cut"))
        new = new.withColumn("cut", F.when(F.col("v") == F.col("s"), F.col("cut")).otherwise(F.sort_array(intersect_keeping(F.col("cut"), F.col("cut"), F.col("v")))))
        now = stored(new.select("qid", "s", "t", F.lit(d).alias("level"), "v", "par", "cut"), "cuts")
        levels.append(now)
    return reduce(DataFrame.unionByName, levels).select("qid", "level", "v", "par", "cut")


def cut_pruned(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Backward search from t; a vertex is rejected if all walks that reach it in the remaining hops pass the path already taken."""
    cuts = stored(cut_sets(edges, queries, k), "cut-sets")
    back, found = start(queries, "t"), []
    r = sized(reverse(edges))
    for d in range(1, k + 1):
        nxt = expand(back, r, stop="s")
        need = product(F.col("par"), F.col("sigma"))
        at = cuts.where(F.col("level") == k - d).select("qid", "v", F.col("par").alias("need"), "cut")
        # The path ends in v itself, which its own cut holds.
        nxt = nxt.withColumn("need", need).join(at, ["qid", "v", "need"]).where(~F.arrays_overlap("cut", F.slice("path", 1, F.size("path") - 1)))
        nxt = nxt.drop("need", "cut")
        if found and found[-1] is back:
            nxt = nxt.join(back.where("v = s and par = sigma").select("qid").distinct(), "qid", "left_anti")
        back = counted(nxt, "cut-paths", d, hits=F.count_if((F.col("v") == F.col("s")) & (F.col("par") == F.col("sigma"))))
        if seen(back)["hits"]:
            found.append(back)
        if not rows_of(back):
            break
    hits = [x.where("v = s and par = sigma").select("qid") for x in found]
    return reduce(DataFrame.unionByName, hits).distinct() if hits else queries.select("qid").limit(0)


def staged_by_cuts(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return staged(edges, queries, k, cut_pruned)
