"""Simple-path search: exhaustive, distance-pruned, two-sided, bidirectional, automaton, and per-query kernels.

All of them take edges (src, dst, sgn) and open queries (qid, s, t, sigma) whose ends differ and exist, and return the
qids for which a simple path of at most k edges has sign sigma. Rows of a search are half paths
(qid, s, t, sigma, v, par, len, path). A search never goes on from t, and once a query is answered its rows go.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpath.durable import counted, rows_of, seen, stored
from signpath.functions.signs import meets_only_once, product

from . import intask
from .graph import reverse, sized
from .walks import ball, product_candidates, signed_ball

STATE = ["qid", "s", "t", "sigma", "v", "par", "len", "path"]


def start(queries: DataFrame, end: str = "s") -> DataFrame:
    return queries.select("qid", "s", "t", "sigma", F.col(end).alias("v"), F.lit(1).alias("par"), F.lit(0).alias("len"), F.array(end).alias("path"))


def expand(paths: DataFrame, edges: DataFrame, stop: str = "t", on: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """One edge more, to a vertex that isn't on the path yet."""
    met = paths.where(F.col("v") != F.col(stop)).join(edges, (F.col("v") == F.col("src")) if on is None else on)
    met = met.where(~F.array_contains("path", F.col("dst")))
    return met.select("qid", "s", "t", "sigma", F.col("dst").alias("v"), product(F.col("par"), F.col("sgn")).alias("par"), (F.col("len") + 1).alias("len"), F.concat("path", F.array("dst")).alias("path"), *extra)


def _hits(paths: DataFrame) -> DataFrame:
    return paths.where("v = t and par = sigma").select("qid").distinct()


def search(queries: DataFrame, edges: DataFrame, k: int, prune: Callable[[DataFrame, int], DataFrame] = lambda x, d: x, on: Column | None = None) -> DataFrame:
    """Level by level; ``prune`` sees each new level and its number. Levels are stored, so that none is computed twice.

    A level is one job, which also counts its rows and hits, so that the search ends when nothing is left.
    """
    now, found = start(queries), []
    for d in range(1, k + 1):
        nxt = prune(expand(now, edges, on=on), d)
        if found and seen(now)["hits"]:
            nxt = nxt.join(_hits(now), "qid", "left_anti")
        now = counted(nxt, "paths", d, hits=F.count_if((F.col("v") == F.col("t")) & (F.col("par") == F.col("sigma"))))
        found.append(now)
        if not rows_of(now):
            break
    hits = [_hits(x) for x in found if seen(x)["hits"]]
    return reduce(DataFrame.unionByName, hits).distinct() if hits else queries.select("qid").limit(0)


def exhaustive(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return search(queries, sized(edges), k)


def hopeful(edges: DataFrame, queries: DataFrame, k: int) -> Callable[[DataFrame, int], DataFrame]:
    """A test for ``search``: a walk of the missing sign leads from a half path to t within the remaining hops.

    Distances are needed for the second half of the hops only, where nearly all half paths are; no ball of k hops is built.
    """
    half = (k + 1) // 2
    dist = signed_ball(edges, queries.select(F.col("t").alias("anchor")), k - half, backward=True)
    rest = dist.select(F.col("anchor").alias("t"), "v", F.col("par").alias("need"), F.col("dist").alias("h"))

    def prune(paths: DataFrame, d: int) -> DataFrame:
        if d < half:
            return paths
        own = paths.columns
        return paths.withColumn("need", product(F.col("par"), F.col("sigma"))).join(rest.where(F.col("h") <= k - d), ["t", "v", "need"]).select(*own)

    return prune


def distance_pruned(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Half paths are kept only if a walk of the missing sign leads from them to t within the remaining hops."""
    return search(queries, sized(edges), k, hopeful(edges, queries, k))


def pruned_edges(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, src, dst, sgn, h): the edges that lie on a walk of at most k edges between a query's ends; h hops remain at dst.

    Signs play no part, so that one index serves both. Walks pass neither end on their way. Half of the hops are walked from each end;
    the other half is walked only through what the other end has reached in the hops that remain.
    """
    half = (k + 1) // 2
    ends = {"s": queries.select("qid", F.col("s").alias("anchor"), F.col("t").alias("other")), "t": queries.select("qid", F.col("t").alias("anchor"), F.col("s").alias("other"))}
    from_s, to_t = ball(edges, ends["s"], half), ball(edges, ends["t"], k - half, backward=True)
    plain = edges.select("src", "dst").distinct()

    def beyond(near: DataFrame, far: DataFrame, other: DataFrame, begin: int, e: DataFrame) -> DataFrame:
        """Least distances beyond ``begin`` hops of what ``far`` can still reach."""
        at = near.where(F.col("dist") == begin).join(other.select("qid", "other"), "qid").where("v <> other").select("qid", "v")
        known = far.select("qid", "v", F.col("dist").alias("left"))
        more = []
        for d in range(begin + 1, k + 1):
            at = at.join(e, F.col("v") == F.col("src")).select("qid", F.col("dst").alias("v")).distinct().join(known.where(F.col("left") <= k - d), ["qid", "v"]).select("qid", "v")
            more.append(at.withColumn("dist", F.lit(d)))
        return reduce(DataFrame.unionByName, [near, *more]).groupBy("qid", "v").agg(F.min("dist").alias("dist"))

    ahead = beyond(from_s, to_t, ends["s"], half, sized(plain))
    back = beyond(to_t, from_s, ends["t"], k - half, sized(reverse_plain(plain)))
    both = ahead.withColumnRenamed("dist", "ds").join(back.withColumnRenamed("dist", "dt"), ["qid", "v"]).where(F.col("ds") + F.col("dt") <= k)
    both = stored(both, "between")
    left, right = both.select("qid", F.col("v").alias("src"), "ds"), both.select("qid", F.col("v").alias("dst"), F.col("dt").alias("h"))
    met = left.join(sized(edges), "src").join(right, ["qid", "dst"]).where(F.col("ds") + 1 + F.col("h") <= k)
    outer = queries.select("qid", F.col("s").alias("s0"), F.col("t").alias("t0"))
    met = met.join(outer, "qid").where("dst <> s0 and src <> t0")
    return stored(met.select("qid", "src", "dst", "sgn", "h"), "pruned-edges")


def reverse_plain(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def two_sided(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exhaustive search over each query's own pruned edges."""
    own = pruned_edges(edges, queries, k).withColumnRenamed("qid", "q_")
    on = (F.col("qid") == F.col("q_")) & (F.col("v") == F.col("src")) & (F.col("len") + 1 + F.col("h") <= k)
    return search(queries, own, k, on=on)


def bidirectional(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Half paths from both ends, joined where they meet.

    A path of length L is tested once: split after min(L, ceil(k / 2)) edges.
    """
    half, rest = (k + 1) // 2, k // 2
    now, hits = start(queries), []
    e = sized(edges)
    for d in range(1, half + 1):
        now = counted(expand(now, e), "forward", d, hits=F.count_if((F.col("v") == F.col("t")) & (F.col("par") == F.col("sigma"))))
        if seen(now)["hits"]:
            hits.append(_hits(now))
    # Queries that are answered already don't search from the other end.
    back, sides = start(queries, "t"), []
    if hits:
        back = back.join(reduce(DataFrame.unionByName, hits).distinct(), "qid", "left_anti")
    r = sized(reverse(edges))
    for _ in range(rest):
        back = stored(expand(back, r, stop="s"), "backward")
        sides.append(back)
    if sides:
        f = now.where("v <> t").select("qid", "v", "sigma", F.col("par").alias("pf"), F.col("len").alias("lf"), F.col("path").alias("one"))
        b = reduce(DataFrame.unionByName, sides).select("qid", "v", F.col("par").alias("pb"), F.col("len").alias("lb"), F.col("path").alias("two"))
        met = f.join(b, ["qid", "v"]).where((product(F.col("pf"), F.col("pb")) == F.col("sigma")) & (F.col("lf") + F.col("lb") <= k) & meets_only_once(F.col("one"), F.col("two")))
        hits.append(met.select("qid").distinct())
    return reduce(DataFrame.unionByName, hits).distinct() if hits else queries.select("qid").limit(0)


def automaton(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Simple paths in the product with the hop-and-parity automaton, through states that can still accept.

    Nothing is remembered about failed states: a failure may be due to the path that led there.
    """
    if k < 1:
        return queries.select("qid").limit(0)
    live = stored(product_candidates(edges, queries, k), "live-states")
    state = (F.col("len") * 2 + (1 - F.col("par"))).cast("int")
    return search(queries, sized(edges), k, lambda x, d: x.withColumn("state", state).join(live, ["t", "sigma", "v", "state"], "left_semi").select(*STATE))


def counts_by_sign(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, len, par, paths): how many simple paths from s to t there are of each length and sign."""
    if intask.fits(edges, k, whole=True):
        return intask.counts_by_sign(edges, queries, k)
    now, found, e = start(queries), [], sized(edges)
    for _ in range(k):
        now = stored(expand(now, e), "all-paths")
        found.append(now.where("v = t"))
    return reduce(DataFrame.unionByName, found).groupBy("qid", "len", "par").agg(F.count("*").alias("paths"))


def shortest_lengths(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, par, len): least length of a simple path from s to t of each sign, up to k."""
    own = pruned_edges(edges, queries, k).withColumnRenamed("qid", "q_")
    on = (F.col("qid") == F.col("q_")) & (F.col("v") == F.col("src")) & (F.col("len") + 1 + F.col("h") <= k)
    now, found = start(queries), []
    for _ in range(k):
        now = stored(expand(now, own, on=on), "all-paths")
        found.append(now.where("v = t").select("qid", "par", "len").distinct())
    return reduce(DataFrame.unionByName, found).groupBy("qid", "par").agg(F.min("len").alias("len"))
