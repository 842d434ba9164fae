"""Running numpy code over Arrow batches of a DataFrame."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from signpath.shipping import ship

#: Rows that are turned to Python memory at once.
BATCH_ROWS = 2000
#: Bounds of the batches that Spark sends to Python; a task holds some of them inside and outside the JVM's heap.
BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to ``BOUNDS`` where they are larger."""
    for key, most in BOUNDS.items():
        size = re.fullmatch(r"(-?\d+)\s*([bkmg]?).*", spark.conf.get(key).lower())
        now = int(size[1]) << {"k": 10, "m": 20, "g": 30}.get(size[2], 0) if size else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: T.StructType | str, after: Callable[[], None] | None = None, rows: int = BATCH_ROWS) -> DataFrame:
    """``make`` gets a batch and returns a value for each column of ``schema`` (numpy or Arrow), or None for no rows; it gets ``rows`` at a time.

    ``after`` runs at a task's end.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    fields = to_arrow_schema(schema)
    ship(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with trimmed(after):
            for whole in batches:
                for lo in range(0, whole.num_rows, rows):
                    out = make(whole.slice(lo, rows))
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([_as(out[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def trimmed(after: Callable[[], None] | None = None) -> Iterator[None]:
    """Give a task's memory back at its end, also if it fails: the process goes on to other tasks and other stages."""
    try:
        yield
    finally:
        if after:
            after()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
            ctypes.CDLL(None).malloc_trim(0)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
