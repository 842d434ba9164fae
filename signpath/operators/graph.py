"""Normalisation, statistics, ranks and offsets of signed edge tables (src, dst, sgn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpath.durable import rows_of, stored

#: Edge tables of at most so many rows are broadcast to a join; larger ones are joined by shuffle.
BROADCAST_EDGES = 1_000_000


def reverse(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sgn")
    if hasattr(edges, "_seen"):
        out._seen = edges._seen
    return out


def sized(edges: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows allow."""
    return F.broadcast(edges) if rows_of(edges) <= BROADCAST_EDGES else edges


def vertex_count(edges: DataFrame) -> int:
    """One more than the largest vertex; smaller vertices without edges exist too."""
    return int(edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0))).first()[0])


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(v, d_out, d_in)."""
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("v").agg(F.sum("o").cast("bigint").alias("d_out"), F.sum("i").cast("bigint").alias("d_in"))


def running(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the running sum of ``value`` in a total order, without a task that sees all rows.

    Rows are sorted into ranges and stored; sums within a range are added to the sums of the ranges before it, one number a range.
    """
    own = df.columns
    ranges = stored(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("value", value.cast("bigint")), "ranges")
    rows = ranges.withColumn("range", F.shiftrightunsigned("at", 33))
    sums = rows.groupBy("range").agg(F.sum("value").alias("sum"))
    before = sums.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("before"))
    inside = F.sum("value").over(Window.partitionBy("range").orderBy("at"))
    out = rows.withColumn("inside", inside).join(F.broadcast(before), "range").select(*own, (F.col("inside") + F.col("before")).cast("bigint").alias(name))
    out._spent = ranges
    return out


def ranked(edges: DataFrame) -> DataFrame:
    """(v, d_out, d_in, rank): by product of degrees, largest first, then by vertex."""
    return running(degrees(edges), F.lit(1), [(F.col("d_in") * F.col("d_out")).desc(), F.col("v")], "rank")


def offsets(edges: DataFrame) -> DataFrame:
    """(v, begin, finish): places of each vertex's out-edges in an array sorted by source."""
    return running(degrees(edges), F.col("d_out"), [F.col("v")], "finish").select("v", (F.col("finish") - F.col("d_out")).alias("begin"), "finish")


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, out): sorted neighbours with signs."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list(F.struct("dst", "sgn"))).alias("out"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: n, m, positive, negative, sources, targets."""
    return edges.agg(
        F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).cast("bigint").alias("n"),
        F.count("*").alias("m"),
        F.count_if(F.col("sgn") == 1).alias("positive"),
        F.count_if(F.col("sgn") == 0).alias("negative"),
        F.countDistinct("src").alias("sources"),
        F.countDistinct("dst").alias("targets"),
    )


def sign_balance(edges: DataFrame) -> DataFrame:
    """(v, positive, negative, mixed) over out-edges; mixed counts targets with parallel edges of either sign."""
    pairs = edges.groupBy("src", "dst").agg(F.count_if(F.col("sgn") == 1).alias("p"), F.count_if(F.col("sgn") == 0).alias("q"))
    return pairs.groupBy(F.col("src").alias("v")).agg(F.sum("p").cast("bigint").alias("positive"), F.sum("q").cast("bigint").alias("negative"), F.count_if((F.col("p") > 0) & (F.col("q") > 0)).alias("mixed"))
