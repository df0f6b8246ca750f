"""Windows, sessions and latest values over events: as batch queries, and the same transformations on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windows(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and type; works on a stream with a watermark too."""
    grouped = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's runs of events without a pause of ``gap``."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "events")


def session_spans(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's runs of events without a pause of ``gap``, with the times of their first and last events."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"))
    return grouped.select("user_id", "session_start", "session_end")


def as_of(events: DataFrame, kind: str = "click") -> DataFrame:
    """For each event its user's last value of a kind at that time."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.select("event_id", F.last(F.when(F.col("event_type") == kind, F.col("value")), ignorenulls=True).over(order).alias("last_click"))


def stream_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The windows of a stream; events later than ``late`` are left out, closed windows leave the state."""
    return windows(events.withWatermark("ts", late), size)


def deduplicated(events: DataFrame, key: str = "event_id", within: str = "2 hours") -> DataFrame:
    """A stream without repeats of a key that come within ``within``."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


PENDING = "msg_id long, session_id string, pending string, reply string"


def stream_pending_images(messages: DataFrame) -> DataFrame:
    """Messages that answer an unclear image request right before them, on a stream of (msg_id, session_id, ord, text, unclear).

    A session's state is its last message if that was unclear, else nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ord", "msg_id"])
        out = []
        for r in rows.itertuples():
            if waiting is not None:
                out.append((r.msg_id, key[0], waiting, r.text))
            waiting = r.text if r.unclear else None
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update((waiting,))
        yield pd.DataFrame(out, columns=["msg_id", "session_id", "pending", "reply"])

    return messages.groupBy("session_id").applyInPandasWithState(step, PENDING, "waiting string", "append", GroupStateTimeout.NoTimeout)


def stream_latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """A table of the last row of each key of a stream, for output in update or complete mode."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(key, "row.*")
