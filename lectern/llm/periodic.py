"""Periodic runs of words in texts, and texts without their repetitions, with the tandem repeats of ``tandem``.

Each slice of texts is worked through inside the task that reads it; nothing is shuffled. Memory goes with the words of a slice, or of one longer text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scalars import bound

from .common import map_texts, texts_of
from .tandem import Run, runs_of

LEAST, EXPONENT = 6, 4
SPACE = r"[\x20\x09-\x0D]+"
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words in none of the ``runs`` behind its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, by start and period) and collapsed text of every row of ``docs`` (doc_id, text).

    Words are what white space of ASCII parts. A run is a stretch of words with a smallest period q, of ``least`` and ``exponent`` * q words at least, which no
    neighbouring word extends. Null, empty and wordless texts have no runs and an empty collapsed text; repeated rows and null doc_ids come out as they are; other columns aren't read; no rows give none.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.encode("utf-8", "surrogatepass").split() for t in texts_of(batch, "text")]
        found = runs_of(texts, least, exponent)
        flat = np.array([run for runs in found for run in runs], np.int64).reshape(-1, 3)
        values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), values)
        left = [collapsed(*x).decode("utf-8", "surrogatepass") for x in zip(texts, found)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), runs, pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", f"doc_id long, n_words long, runs array<{RUN}>, collapsed string", work)


def looped(doc_id: Column, text: Column) -> Column:
    """The text in which, for one document in ten, the words from some word on repeat the first of them; others as they are."""

    def of_words(h: Column, words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))
        return F.array_join(again, " ")

    h = F.crc32(doc_id.cast("string"))
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    return F.when(h % 10 == 0, bound(words, lambda own: of_words(h, own))).otherwise(text)


def greatest_run(runs: Column) -> Column:
    """The run of the greatest exact length / period, the first of equals; null if there is none."""
    none = F.lit(None).cast(RUN)
    more = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, none, lambda best, run: F.when(more(best, run), run).otherwise(best))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which one in ten is made periodic from some word on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))).withColumn("best", greatest_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
