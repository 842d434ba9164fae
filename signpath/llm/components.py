"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the least node that each node of ``edges`` (u, v) can reach.

    Rounds of large-star and small-star (Kiveris and others, 2014): every node's neighbours are hooked to the least node
    around it until the links are stars. The number of rounds grows with the logarithm of the longest path. Links
    are partitioned by node, each round is written to the shared folder, and only two numbers a round
    reach the driver.
    """
    now = stored(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        after = stored(small.distinct(), "links")
        new = _mark(after)
        discard(now)
        now = after
        if new == mark:
            break
        mark = new
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _mark(df: DataFrame) -> tuple[int, int]:
    """Number of links and a checksum of them."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)
