"""Strong components, their condensation in topological levels, and search by component.

Strong components come from colouring: colours (least vertex that reaches a vertex) spread forward to a fixed point,
then each colour's root collects backward what keeps its colour; what is collected is a component, and the
rest goes on. Vertices without edges into or out of the rest are components of their own and go first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpath.durable import stored

from .graph import vertices
from .kernels import search_by_blocks

HOPS = 4


def _settle(state: DataFrame, step, hops: int = HOPS) -> DataFrame:
    """Repeat ``step`` (some hops a job) until the stored table stays the same."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first())
    state = stored(state, "spread")
    old = mark(state)
    while True:
        new = state
        for _ in range(hops):
            new = step(new)
        state = stored(new, "spread")
        now = mark(state)
        if now == old:
            return state
        old = now


def strong_components(edges: DataFrame) -> DataFrame:
    """(v, comp): the least vertex of each vertex's strong component."""
    arcs = stored(edges.select("src", "dst").distinct(), "arcs")
    left = stored(vertices(edges).select("v"), "left")
    done = []
    while left.limit(1).count():
        # Only vertices with both kinds of edges among the rest can be in a larger component.
        while True:
            core = left.join(arcs.select(F.col("src").alias("v")).distinct(), "v", "left_semi").join(arcs.select(F.col("dst").alias("v")).distinct(), "v", "left_semi")
            core = stored(core, "core")
            trimmed = stored(left.join(core, "v", "left_anti").select("v", F.col("v").alias("comp")), "trimmed")
            n = trimmed.count()
            done.append(trimmed)
            left = core
            if not n:
                break
            arcs = stored(arcs.join(core.withColumnRenamed("v", "src"), "src", "left_semi").join(core.withColumnRenamed("v", "dst"), "dst", "left_semi"), "arcs")
        if not left.limit(1).count():
            break

        def spread(colours: DataFrame) -> DataFrame:
            told = arcs.join(colours, F.col("src") == F.col("v")).select(F.col("dst").alias("v"), "colour")  # noqa: B023
            return colours.unionByName(told).groupBy("v").agg(F.min("colour").alias("colour"))

        colours = _settle(left.select("v", F.col("v").alias("colour")), spread)
        one, two = (colours.select(F.col("v").alias(c), F.col("colour").alias(f"c_{c}")) for c in ("src", "dst"))
        same = stored(arcs.join(one, "src").join(two, "dst").where("c_src = c_dst").select("src", "dst"), "same-colour")

        def collect(found: DataFrame) -> DataFrame:
            back = same.join(found, F.col("dst") == F.col("v")).select(F.col("src").alias("v"), "comp")  # noqa: B023
            return found.unionByName(back).distinct()

        found = _settle(colours.where("v = colour").select("v", F.col("colour").alias("comp")), collect)
        done.append(found)
        left = stored(left.join(found, "v", "left_anti"), "left")
        arcs = stored(arcs.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi"), "arcs")
    out = done[0] if done else vertices(edges).select("v", F.col("v").alias("comp"))
    for x in done[1:]:
        out = out.unionByName(x)
    return stored(out, "strong")


def condensation(edges: DataFrame, component: DataFrame) -> DataFrame:
    """(src, dst): arcs between components."""
    one, two = (component.select(F.col("v").alias(c), F.col("comp").alias(f"comp_{c}")) for c in ("src", "dst"))
    return edges.join(one, "src").join(two, "dst").where("comp_src <> comp_dst").select(F.col("comp_src").alias("src"), F.col("comp_dst").alias("dst")).distinct()


def topological_levels(edges: DataFrame, component: DataFrame) -> DataFrame:
    """(comp, level): the longest way to a component over the condensation, which is its place in a topological order."""
    arcs = stored(condensation(edges, component), "condensed")

    def raise_(levels: DataFrame) -> DataFrame:
        told = arcs.join(levels, F.col("src") == F.col("comp")).select(F.col("dst").alias("comp"), (F.col("level") + 1).alias("level"))
        return levels.unionByName(told).groupBy("comp").agg(F.max("level").alias("level"))

    return _settle(component.select("comp").distinct().withColumn("level", F.lit(0)), raise_)


def by_component(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, len, blocks): shortest simple paths and the blocks that they cross, after whole components that no path can pass are dropped.

    A simple path goes through the condensation in order of level, so that only edges between the levels of its ends matter.
    What is left of each query is solved block by block over its own pruned edges.
    """
    comp = strong_components(edges)
    level = topological_levels(edges, comp)
    placed = stored(comp.join(level, "comp").select("v", "level"), "levels")
    ends = queries.join(placed.select(F.col("v").alias("s"), F.col("level").alias("from_level")), "s").join(placed.select(F.col("v").alias("t"), F.col("level").alias("to_level")), "t")
    possible = stored(ends.where("from_level <= to_level").select("qid", "s", "t", "sigma"), "possible")
    return search_by_blocks(edges, possible, k)
