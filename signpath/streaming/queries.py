"""Answering a stream of queries against a fixed graph; stateless, as each query stands for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from signpath.plans.reach import reach


def answer_stream(edges: DataFrame, queries: DataFrame, k: int, path: str, checkpoint: str, strategy: str = "cascade") -> StreamingQuery:
    """Append the results of every micro-batch of ``queries`` (qid, s, t, sigma) to Parquet under ``path``, in a folder a batch.

    A batch that is run again after a failure overwrites its own folder, so that each query is answered once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        reach(edges, rows, k, strategy).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
