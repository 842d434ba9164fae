"""Things that several corpus operators need: bounded samples, folds, tables, free column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signpath.durable import discard, shared_dir, stored

__all__ = ["FOLDS", "bounded_sample", "discard", "free_name", "held_out", "quoted", "release", "remainder", "shared_dir", "stored", "table"]

#: Rows whose crc32 has this remainder are never learnt from.
FOLDS = 5


def remainder(key: str = "doc_id") -> Column:
    """crc32 of the key as text, mod 5. Null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(remainder(key) == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``; all rows where there are no more.

    The count reads no column but those that the filter of ``df`` needs. The choice depends on nothing
    but keys, so that a lost task chooses the same rows again.
    """
    total = df.select(key).count()
    if total <= bound:
        return df
    share = int(bound / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 30)) < share)


def release(spark: SparkSession) -> None:
    """Have the executors' JVMs collect garbage, after which they give most of their free heap back to the system.

    A heap grows with one stage and would keep its size beside the Python processes of the next. There are two short tasks a core, so that
    every executor gets some.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as one identifier, whatever dots or blanks it holds."""
    return "`" + name.replace("`", "``") + "`"


def free_name(columns: list[str], like: str) -> str:
    """A name that no column has, whatever its case."""
    used = {c.lower() for c in columns}
    while like.lower() in used:
        like += "_"
    return like
