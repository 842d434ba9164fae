"""The stages of the corpus pipeline: quality rules, line frequency, near-duplicate join, source mixing, BPE encoding.

Each takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Columns besides doc_id, text and source, of any
name, pass through all stages but the last. Empty tables give empty results. Null and empty texts are rejected by the first stage.
Each stage begins with executors that have given back what the stage before left free in their heaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, linefreq, mixing, rules
from .shared import discard, release, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the isolation forest keep.

    A null, empty or short text is rejected; a null doc_id is judged like any other; repeated rows are judged each by itself.
    """
    release(spark)
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines.

    A null text stays null, a text of boilerplate alone becomes empty; a null source is a source of its own.
    """
    release(spark)
    return linefreq.drop_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id.

    Texts without words link with nothing and stay. Of rows with equal doc_id and text one stays. A row without doc_id stays
    unless a document with one has the same shingles.
    """
    release(spark)
    return jaccard.representatives(docs)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them.

    A null source is a source of its own; rows of a source without words stay once; rows with equal doc_id share their fate.
    """
    release(spark)
    return mixing.realised(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of every row; null and empty texts have no tokens.

    The encoder remembers less than by itself, as executors have grown in the stages before.
    """
    release(spark)
    return bpe.digests(docs, bpe.Params(memory=16 << 20, together=1 << 20, keep=False))


STAGES = [("quality_rules", quality), ("line_frequency", lines), ("near_duplicates", near_duplicates), ("source_mixing", sources), ("bpe_encoding", encode)]

#: SQL can express neither an isolation forest nor a BPE vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next, and goes once the next is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(docs, "_stored_at"):
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
