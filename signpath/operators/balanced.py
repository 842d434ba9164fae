"""Balanced (positive) paths over a table of alternating segments.

A segment leads from v over positive edges and one last negative edge to u. A search takes positive edges one by one and
negative edges in pairs: a negative edge, then a segment. So every half path is positive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpath.durable import stored

from .graph import sized
from .walks import distances


def segments(edges: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """(v, u, len, seg): simple segments of at most k edges from the vertices ``sources`` (v)."""
    e = sized(edges)
    now = sources.select("v", F.col("v").alias("u"), F.lit(0).alias("len"), F.array("v").alias("seg"))
    out = []
    for _ in range(k):
        nxt = now.join(e, F.col("u") == F.col("src")).where(~F.array_contains("seg", F.col("dst")))
        nxt = stored(nxt.select("v", F.col("dst").alias("u"), (F.col("len") + 1).alias("len"), F.concat("seg", F.array("dst")).alias("seg"), "sgn"), "segments")
        out.append(nxt.where("sgn = 0").drop("sgn"))
        now = nxt.where("sgn = 1").drop("sgn")
    return reduce(DataFrame.unionByName, out)


def balanced_search(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qids of the queries with a positive simple path of at most k edges (sigma isn't looked at)."""
    if k < 1:
        return queries.select("qid").limit(0)
    e = sized(edges)
    h = stored(distances(edges, queries.select("qid", F.col("t").alias("anchor"), F.col("s").alias("other")), k, backward=True).select("qid", "v", F.col("dist").alias("h")), "hops")
    # A segment starts where a negative edge ends, with at least two edges gone at its end.
    heads = edges.where("sgn = 0").select(F.col("dst").alias("v")).distinct()
    table = stored(segments(edges, heads, k - 1), "segment-table") if k > 1 else None
    levels = {0: queries.select("qid", "s", "t", F.col("s").alias("v"), F.lit(0).alias("len"), F.array("s").alias("path"))}
    pending: dict[int, list[DataFrame]] = {}
    found = []
    for d in range(k):
        here = [levels[0]] if d == 0 else pending.get(d, [])
        if not here:
            continue
        now = stored(reduce(DataFrame.unionByName, here).distinct(), "balanced")
        found.append(now.where("v = t").select("qid").distinct())
        open_ = now.where("v <> t").join(found[-1], "qid", "left_anti")
        step = open_.join(e, F.col("v") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        fits = lambda x: x.join(h, ["qid", "v"]).where(F.col("len") + F.col("h") <= k).drop("h")
        plus = step.where("sgn = 1").select("qid", "s", "t", F.col("dst").alias("v"), (F.col("len") + 1).alias("len"), F.concat("path", F.array("dst")).alias("path"))
        pending.setdefault(d + 1, []).append(fits(plus))
        if table is None:
            continue
        minus = step.where("sgn = 0 and dst <> t").select("qid", "s", "t", F.col("dst").alias("v"), "path")
        met = minus.join(table.where(F.col("len") <= k - d - 1), "v")
        # Neither end may lie inside a segment: t only as its last vertex.
        met = met.where(~F.arrays_overlap("path", "seg") & ~F.array_contains(F.slice("seg", 1, F.size("seg") - 1), F.col("t")))
        met = stored(met.select("qid", "s", "t", F.col("u").alias("v"), (F.col("len") + d + 1).alias("len"), F.concat("path", "seg").alias("path")), "pairs")
        for size in range(d + 2, k + 1):
            pending.setdefault(size, []).append(fits(met.where(F.col("len") == size)))
    for rows in pending.get(k, []):
        found.append(rows.where("v = t").select("qid"))
    return reduce(DataFrame.unionByName, found).distinct()
