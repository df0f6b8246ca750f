"""Keyed state over streams with timers: latest rows, session buffers and pending requests.

Each processor keeps for a key only what later rows can still need, takes rows in any order and any number of times, and gives what the batch operator of the
same name gives over all rows. State lies in RocksDB with a changelog in the checkpoint, so a query goes on after it was stopped, or an executor lost, where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Buffers(StatefulProcessor):
    """The parts of each key in their order as one text of ``limit`` characters at most, given out whenever it changes.

    A part that comes again counts once, as it came last. Parts behind those that fill the limit are dropped: what comes before them can only move them farther.
    """

    def __init__(self, key: str, order: str, text: str, glue: str, limit: int):
        self.key, self.order, self.text, self.glue, self.limit = key, order, text, glue, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "at long, part string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = dict(self.parts.get()) if self.parts.exists() else {}
        before = dict(held)
        for frame in rows:
            for at, part in zip(frame[self.order], frame[self.text]):
                if not pd.isna(at):
                    held[int(at)] = "" if part is None or pd.isna(part) else part[: self.limit]
        kept, filled = [], 0
        for at in sorted(held):
            if filled >= self.limit:
                break
            filled += len(held[at]) + (len(self.glue) if kept else 0)
            kept.append((at, held[at]))
        if dict(kept) != before:
            self.parts.put(kept)
            yield pd.DataFrame([(*key, self.glue.join(p for _, p in kept)[: self.limit])], columns=[self.key, "buffer"])


class Pending(StatefulProcessor):
    """Messages that answer an unclear request right before them, with the request; a session's messages are taken in order of their times.

    A message waits, by a timer, until the watermark has passed its time, so one that comes later than others but within the watermark's delay is in its
    place. What comes again, or later than that, is left out. A request that isn't answered within ``patience`` is forgotten, where that is given.
    """

    def __init__(self, patience_ms: int | None = None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "at long, ord long, msg_id long, text string, unclear boolean")
        self.request = handle.getValueState("request", "text string, at long")
        self.done = handle.getValueState("done", "at long, ord long, msg_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        queue = {r[:3]: r for r in (self.queue.get() if self.queue.exists() else ())}
        done = self.done.get() if self.done.exists() else None
        for frame in rows:
            at = frame["ts"].astype("datetime64[ms]").astype("int64")
            for row in zip(at.tolist(), frame["ord"].tolist(), frame["msg_id"].tolist(), frame["text"], frame["unclear"].tolist()):
                if row[:3] not in queue and (done is None or row[:3] > tuple(done)):
                    queue[row[:3]] = (*row[:3], row[3] if isinstance(row[3], str) else None, bool(row[4]))
                    self.handle.registerTimer(row[0])
        self.queue.put(sorted(queue.values(), key=lambda r: r[:3]))
        yield pd.DataFrame([], columns=["msg_id", "session_id", "pending", "reply"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(self.queue.get() if self.queue.exists() else (), key=lambda r: r[:3])
        ready, later = [r for r in rows if r[0] <= until], [r for r in rows if r[0] > until]
        request, out = self.request.get() if self.request.exists() else None, []
        for at, _, msg_id, text, unclear in ready:
            if request is not None and (self.patience is None or at - request[1] <= self.patience):
                out.append((msg_id, key[0], request[0], text))
            request = (text, at) if unclear else None
        if ready:
            self.done.update(ready[-1][:3])
            self.queue.put(later) if later else self.queue.clear()
            self.request.clear() if request is None else self.request.update(request)
        yield pd.DataFrame(out, columns=["msg_id", "session_id", "pending", "reply"])


def stream_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the greatest whole number ``order`` of each key of a stream, for output in update mode; rows without an order are left out.

    A key's state is that row alone. It is an aggregate, without a timer or a call of Python for each key, and gives a key's row out whenever rows of it come.
    """
    at = F.col(order).cast("long")
    rest = [f.name for f in rows.schema if f.name != key]
    return rows.where(at.isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("row")).select(key, "row.*")


def stream_buffers(parts: DataFrame, key: str, order: str, text: str, glue: str = "\n\n", limit: int = 12_000) -> DataFrame:
    """``key`` and buffer of a stream of parts, for output in update mode."""
    schema = T.StructType([parts.schema[key], T.StructField("buffer", T.StringType())])
    return parts.groupBy(key).transformWithStateInPandas(Buffers(key, order, text, glue, limit), schema, "Update", "None")


def stream_pending(messages: DataFrame, delay: str, patience_ms: int | None = None) -> DataFrame:
    """msg_id, session_id, pending and reply of a stream of (session_id, msg_id, ord, ts, text, unclear) that is up to ``delay`` out of order."""
    rows = messages.select("session_id", "msg_id", "ord", F.col("ts").cast("timestamp").alias("ts"), "text", "unclear").withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithStateInPandas(Pending(patience_ms), "msg_id long, session_id string, pending string, reply string", "Append", "EventTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside of it keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """All of a stream that is there, appended to Parquet under ``path`` in a folder for each batch; what a batch wrote before it failed is written over."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_in_rocksdb(stream.sparkSession):
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_output(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The rows that ``run_available`` wrote last for each key."""
    rows = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).option("basePath", path).parquet(f"{path}/batch=*")
    rest = [f.name for f in schema if f.name != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(key, "row.*")
