"""Queries that run streams with keyed state over all that the tables hold, and give what the batch queries give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import routing as R
from lectern.functions.scalars import text_of
from lectern.plans import chat
from lectern.session import table
from lectern.sources.fixtures import view
from lectern.sources.scratch import scratch_path
from lectern.streaming import state as K

DELAY = "1 day"


def _streamed(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` as a stream of files, and where they lie."""
    path = scratch_path(spark, "input")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path), path


def _last(spark: SparkSession, stream: DataFrame, key: str) -> DataFrame:
    out = scratch_path(spark, "output")
    K.run_available(stream, out, scratch_path(spark, "checkpoint"))
    return K.last_output(spark, out, stream.schema, key)


def _upserts(s: SparkSession, d: str) -> DataFrame:
    return _last(s, K.stream_latest(_streamed(s, view(s, d, "log_events"))[0], "log_id", "op_seq"), "log_id")


def _buffers(s: SparkSession, d: str) -> DataFrame:
    section = F.concat(F.lit("--- Document: "), F.col("turn").cast("string"), F.lit(" ---\n"), text_of(F.col("text")))
    rows = table(s, d, "conversations").select("conv_id", "turn", section.alias("part"))
    return _last(s, K.stream_buffers(_streamed(s, rows)[0], "conv_id", "turn", "part"), "conv_id")


def _pending(s: SparkSession, d: str) -> DataFrame:
    """A second run over a message of a later time, from the same checkpoint, lets the watermark pass all others."""
    text = F.col("text")
    rows = view(s, d, "messages").select("session_id", F.col("msg_id").cast("long").alias("msg_id"), F.col("ord").cast("long").alias("ord"), F.timestamp_seconds(F.col("ord").cast("long")).alias("ts"), "text", (R.is_image_request(text) & (R.image_intent(text) == "ambiguous")).alias("unclear"))
    stream, path = _streamed(s, rows)
    out, checkpoint = scratch_path(s, "output"), scratch_path(s, "checkpoint")
    found = K.stream_pending(stream, DELAY)
    K.run_available(found, out, checkpoint, "append")
    after = rows.agg(F.max("ts").alias("ts")).select(F.lit("").alias("session_id"), F.lit(0).cast("long").alias("msg_id"), F.lit(0).cast("long").alias("ord"), (F.col("ts") + F.expr(f"interval {DELAY}") * 2).alias("ts"), F.lit("").alias("text"), F.lit(False).alias("unclear"))
    after.write.mode("append").parquet(path)
    K.run_available(found, out, checkpoint, "append")
    return s.read.schema(found.schema).parquet(f"{out}/batch=*")


QUERIES = {"stream_upsert_latest": _upserts, "stream_session_buffer": _buffers, "stream_pending_image": _pending}

ORACLES = {
    "stream_upsert_latest": chat.ORACLES["log_upsert_latest"],
    "stream_session_buffer": "SELECT conv_id, substring(string_agg(concat('--- Document: ', turn, ' ---', chr(10), coalesce(text, '')), chr(10) || chr(10) ORDER BY turn), 1, 12000) AS buffer FROM conversations GROUP BY conv_id",
    "stream_pending_image": chat.ORACLES["pending_image"],
}
