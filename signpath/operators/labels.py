"""Signed two-hop labels with witnesses, built for walks of at most k edges.

Vertices are ranked; batches of hubs in order of rank label what reaches them and what they reach, through vertices of lower
priority only, and leave out what hubs of earlier batches cover. For a simple path the best ranked of its vertices
is a hub that both ends know, so that no common hub means no. A common hub means that a walk exists; a
witness that is simple means yes. Labels depend on k, as distances beyond it are never needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpath.durable import stored
from signpath.functions.signs import is_simple, product

from .cascade import staged
from .graph import ranked, reverse

BATCHES = (64, 1024)


def _side(edges: DataFrame, hubs: DataFrame, k: int, cover: tuple[DataFrame, DataFrame] | None, name: str) -> DataFrame:
    """(hub, v, par, dist, path) of one direction; ``edges`` carry the rank of their dst."""
    levels = [stored(hubs.select(F.col("v").alias("hub"), F.col("rank").alias("hub_rank"), "v", F.lit(1).alias("par"), F.lit(0).alias("dist"), F.array("v").alias("path")), name)]
    for d in range(1, k + 1):
        met = levels[-1].join(edges, F.col("v") == F.col("src")).where("dst_rank > hub_rank")
        new = met.select("hub", "hub_rank", F.col("dst").alias("v"), product(F.col("par"), F.col("sgn")).alias("par"), F.lit(d).alias("dist"), F.concat("path", F.array("dst")).alias("path"))
        new = new.groupBy("hub", "hub_rank", "v", "par", "dist").agg(F.min("path").alias("path"))
        seen = reduce(DataFrame.unionByName, [x.select("hub", "v", "par") for x in levels])
        new = new.join(seen, ["hub", "v", "par"], "left_anti")
        if cover is not None:
            mine, theirs = cover
            known = mine.select("v", F.col("hub").alias("via"), F.col("par").alias("p1"), F.col("dist").alias("d1"))
            hub = theirs.select(F.col("v").alias("hub"), F.col("hub").alias("via"), F.col("par").alias("p2"), F.col("dist").alias("d2"))
            covered = new.select("hub", "v", "par", "dist").join(known, "v").join(hub, ["hub", "via"]).where((F.col("d1") + F.col("d2") <= F.col("dist")) & (product(F.col("p1"), F.col("p2")) == F.col("par")))
            new = new.join(covered.select("hub", "v", "par").distinct(), ["hub", "v", "par"], "left_anti")
        levels.append(stored(new, name))
    return reduce(DataFrame.unionByName, levels).drop("hub_rank")


def build(edges: DataFrame, k: int, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """(side, v, par, hub, dist, path): side ``out`` for walks v to hub, ``in`` for walks hub to v; paths run from hub to v."""
    rank = stored(ranked(edges).select("v", "rank"), "ranks")
    of = rank.select(F.col("v").alias("dst"), F.col("rank").alias("dst_rank"))
    forward, back = edges.join(of, "dst"), reverse(edges).join(of, "dst")
    outs, ins, begin = [], [], 0
    for end in [*batches, None]:
        hubs = rank.where(F.col("rank") > begin)
        hubs = hubs.where(F.col("rank") <= end) if end else hubs
        if not hubs.limit(1).count():
            break
        old = (reduce(DataFrame.unionByName, outs), reduce(DataFrame.unionByName, ins)) if outs else None
        new_out = stored(_side(back, hubs, k, old, "labels"), "labels-out")
        new_in = stored(_side(forward, hubs, k, old[::-1] if old else None, "labels"), "labels-in")
        outs.append(new_out)
        ins.append(new_in)
        begin = end
    cols = ["side", "v", "par", "hub", "dist", "path"]
    sides = [x.withColumn("side", F.lit(n)).select(*cols) for n, many in (("out", outs), ("in", ins)) for x in many]
    return reduce(DataFrame.unionByName, sides)


def verdicts(labels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, stage): 1 a simple witness, -1 no common hub, 0 a walk that isn't known to be simple."""
    out = labels.where("side = 'out'").select(F.col("v").alias("s"), "hub", F.col("par").alias("p1"), F.col("dist").alias("d1"), F.col("path").alias("w1"))
    into = labels.where("side = 'in'").select(F.col("v").alias("t"), "hub", F.col("par").alias("p2"), F.col("dist").alias("d2"), F.col("path").alias("w2"))
    met = queries.join(out, "s").join(into, ["t", "hub"]).where((F.col("d1") + F.col("d2") <= k) & (product(F.col("p1"), F.col("p2")) == F.col("sigma")))
    whole = F.concat(F.reverse("w1"), F.slice("w2", 2, 2**30))
    hit = met.groupBy("qid").agg(F.max(is_simple(whole).cast("int")).alias("simple"))
    return queries.select("qid").join(hit, "qid", "left").select("qid", F.coalesce("simple", F.lit(-1)).alias("stage"))


def staged_by_labels(edges: DataFrame, queries: DataFrame, k: int, labels: DataFrame | None = None) -> DataFrame:
    """(qid, stage): the label verdict, or for 0 that of the cascade."""
    told = stored(verdicts(stored(build(edges, k), "labels") if labels is None else labels, queries, k), "label-verdicts")
    rest = queries.join(told.where("stage = 0").select("qid"), "qid", "left_semi")
    return told.where("stage <> 0").unionByName(staged(edges, stored(rest, "label-rest"), k))


def label_stats(labels: DataFrame) -> DataFrame:
    """side, labels, vertices, the longest list, the mean list, and an estimate of bytes."""
    per = labels.groupBy("side", "v").agg(F.count("*").alias("n"), F.sum(F.size("path") * 8 + 24).alias("b"))
    return per.groupBy("side").agg(F.sum("n").cast("bigint").alias("labels"), F.count("*").alias("vertices"), F.max("n").cast("bigint").alias("longest"), F.round(F.avg("n"), 6).alias("mean"), F.sum("b").cast("bigint").alias("bytes"))
