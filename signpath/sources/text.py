"""Text formats: edge lists ``source target sign`` and query files ``source,target,sign``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signpath.durable import stored
from signpath.functions.signs import normal_sign
from signpath.operators.graph import running


def parse_edges(lines: DataFrame) -> DataFrame:
    """(src, dst, sgn) of lines in column ``value``.

    Numbers are parted by blanks, tabs or commas; columns after the third are ignored. Malformed lines, self-loops and
    negative vertices are dropped. Equal edges count once; the two signs of one arc are two edges.
    """
    part = F.split(F.trim(F.regexp_replace("value", r"[\s,]+", " ")), " ")
    raw = lines.select(*[F.get(part, i).try_cast("bigint").alias(c) for i, c in enumerate(("src", "dst", "raw"))])
    raw = raw.where("src is not null and dst is not null and raw is not null and src <> dst and src >= 0 and dst >= 0")
    return raw.select("src", "dst", normal_sign(F.col("raw")).alias("sgn")).distinct()


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edges(spark.read.text(path))


def infer_arity(lines: DataFrame, first: int = 10) -> int:
    """Least count of numbers in the first data lines (those that begin with a digit); 0 if there is none."""
    tokens = lines.where(F.col("value").rlike("^[0-9]")).limit(first).select(F.size(F.regexp_extract_all("value", F.lit(r"([0-9.\-]+)"), 1)).alias("n"))
    return tokens.agg(F.min("n")).first()[0] or 0


def parse_edges_strict(lines: DataFrame) -> DataFrame:
    """Like ``parse_edges``, but only lines that begin with a digit and have exactly the inferred count of numbers."""
    n = infer_arity(lines)
    tokens = F.regexp_extract_all("value", F.lit(r"([0-9.\-]+)"), 1)
    return parse_edges(lines.where(F.col("value").rlike("^[0-9]") & (F.size(tokens) == n)).select(F.array_join(F.slice(tokens, 1, 3), " ").alias("value")))


def parse_queries(lines: DataFrame) -> DataFrame:
    """(qid, s, t, sigma) of lines ``(line, value)``; qid is the line number, malformed lines are skipped."""
    part = F.split(F.col("value"), ",")
    raw = lines.select(F.col("line").cast("bigint").alias("qid"), *[F.trim(F.get(part, i)).try_cast("bigint").alias(c) for i, c in enumerate(("s", "t", "raw"))])
    return raw.where("s is not null and t is not null and raw is not null").select("qid", "s", "t", F.when(F.col("raw") == 1, 1).otherwise(0).cast("int").alias("sigma"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines with their numbers from 0, files in order of name. Files are read in splits, by many tasks.

    A line's number is its place in its split and the lines of the splits before, one number a split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = stored(lines, "lines")
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = splits.select("file", "split", "first", (F.sum("n").over(Window.orderBy("file", "split")) - F.col("n")).alias("before"))
    return lines.join(F.broadcast(before), ["file", "split"]).select((F.col("at") - F.col("first") + F.col("before")).alias("line"), "value")


def read_queries(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Queries with their line numbers from 0; ``first`` takes that many lines from the head."""
    lines = numbered_lines(spark, path).where("value <> ''")
    return parse_queries(lines.where(F.col("line") < first) if first is not None else lines)


def shard(queries: DataFrame, offset: int, limit: int) -> DataFrame:
    """The queries from place ``offset`` on, ``limit`` of them, in order of qid."""
    return queries.orderBy("qid").offset(offset).limit(limit)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds qid from 1 in the given order."""
    return running(rows, F.lit(1), [F.col(c) for c in order], "qid")


def write_results(results: DataFrame, path: str, k: int) -> None:
    """Overwrite the results of hop bound k: s, t, sigma, result as CSV."""
    results.orderBy("qid").select("s", "t", "sigma", "result").write.mode("overwrite").csv(f"{path}/k={k}")


def append_summary(summary: DataFrame, path: str) -> None:
    """Append one row a run."""
    summary.write.mode("append").json(path)
