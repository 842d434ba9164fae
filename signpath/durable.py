"""Intermediate tables in the folder that driver and executors share, and counts of what went into them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_tallies: list[list[dict]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a private folder only where it is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="signpath-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def counted(df: DataFrame, name: str, level: int = 0, **more: Column) -> DataFrame:
    """Like ``stored``; ``rows_of`` then knows the number of rows without a job, and ``more`` aggregates are in ``seen``."""
    watch = Observation()
    out = stored(df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()]), name)
    # Spark leaves the observation out of plans that it finds to be empty.
    out._seen = {"rows": 0, **dict.fromkeys(more, 0), **{k: v for k, v in watch.get.items() if v is not None}}
    for tally in _tallies:
        tally.append({"table": name, "level": level, **out._seen})
    return out


def seen(df: DataFrame) -> dict:
    """The aggregates of a ``counted`` table."""
    return df._seen


def rows_of(df: DataFrame) -> int:
    """Number of rows, from the write of a ``counted`` table or by counting."""
    known = getattr(df, "_seen", None)
    return known["rows"] if known else df.count()


@contextlib.contextmanager
def tallied() -> Iterator[list[dict]]:
    """Collects table, level and aggregates of all tables that are counted meanwhile."""
    tally: list[dict] = []
    _tallies.append(tally)
    try:
        yield tally
    finally:
        _tallies.remove(tally)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read again."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
