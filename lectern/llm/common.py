"""What the operators share: shared scratch space, Arrow text access, word splitting."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes apart at a time, unless one text is longer.
SLICE_BYTES = 4 << 20
#: Bytes of rows that Spark hands to a Python worker in one batch, unless one row is longer. Both sides hold a whole batch for each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python hold ``BATCH_BYTES`` at most; Spark's own bounds, rows and 64 MB, leave a batch of long texts very large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns what a worker has freed to the system: workers live on behind their tasks, and the next ones may be others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def checkpointing(spark: SparkSession) -> SparkSession:
    """The session, with a checkpoint folder: the cluster's, or a local one where none is named and all runs on one machine (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    checkpointing(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, and safe when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``keys``, which are stored, marked for sending to all tasks if there are no more than ``most``; beyond that joins deal them out."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most`` bytes in each (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_texts(df: DataFrame, column: str, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], most: int = SLICE_BYTES) -> DataFrame:
    """``work`` over slices of ``df``, inside the tasks that read it; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, column, most):
            if (out := work(part)) is not None and out.num_rows:
                yield out
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
