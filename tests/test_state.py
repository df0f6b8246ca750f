import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import turns as T
from lectern.sources.scratch import scratch_path
from lectern.streaming import state as K


class Feed:
    """A folder that rows are added to, as a stream, with a checkpoint: each ``go`` is a new start from it."""

    def __init__(self, spark, columns, stream, mode="update"):
        self.spark, self.columns, self.stream, self.mode = spark, columns, stream, mode
        self.path, self.out, self.checkpoint = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))

    def go(self, rows):
        self.spark.createDataFrame(rows, self.columns).coalesce(1).write.mode("append").parquet(self.path)
        source = self.spark.readStream.schema(self.columns).parquet(self.path)
        found = self.stream(source)
        self.schema = found.schema
        K.run_available(found, self.out, self.checkpoint, self.mode)

    def last(self, key):
        return K.last_output(self.spark, self.out, self.schema, key)

    def rows(self):
        return self.spark.read.schema(self.schema).parquet(f"{self.out}/batch=*")


def parted(r, rows, n):
    """The rows in ``n`` parts in any order, some of them twice."""
    rows = rows + r.sample(rows, len(rows) // 3)
    r.shuffle(rows)
    return [rows[i::n] for i in range(n)]


def test_latest_rows_with_late_and_repeated_input_and_restarts(spark):
    r = random.Random(1)
    rows = [(f"k{i % 7}", i, r.choice([None, "x", "é\n"]), r.choice([None, 0.1, 1e300])) for i in range(60)] + [("k1", None, "no order", 1.0)]
    feed = Feed(spark, "key string, at long, text string, value double", lambda s: K.stream_latest(s, "key", "at"))
    for part in parted(r, rows, 3):
        feed.go(part)
    want = {}
    for row in rows:
        if row[1] is not None and row[1] >= want.get(row[0], (None, -1))[1]:
            want[row[0]] = row
    assert sorted(map(tuple, feed.last("key").collect())) == sorted(want.values())


@pytest.mark.parametrize("limit", [30, 12_000])
def test_buffers_equal_the_batch_operator(spark, limit):
    r = random.Random(limit)
    rows = [(f"s{i % 4}", i, "x" * r.randint(0, 25)) for i in range(40)] + [("s9", 1, None)]
    feed = Feed(spark, "session string, at long, part string", lambda s: K.stream_buffers(s, "session", "at", "part", limit=limit))
    for part in parted(r, rows, 3):
        feed.go(part)
    want = {}
    for session, _, part in sorted(rows):
        want[session] = (want[session] + "\n\n" if session in want else "") + (part or "")
    assert {k: v for k, v in feed.last("session").collect()} == {k: v[:limit] for k, v in want.items()}


COLUMNS = "session_id string, msg_id long, ord long, ts timestamp, text string, unclear boolean"


def messages(r, n):
    return [(f"s{i % 5}", i, i, i * 10, f"text {i}", r.random() < 0.3) for i in range(n)]


def timed(spark, rows):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    return [(*row[:3], at(row[3]), *row[4:]) for row in rows]


def answered(rows):
    out, last = [], {}
    for session, msg, _, _, text, unclear in sorted(rows, key=lambda x: x[2]):
        if session in last:
            out.append((msg, session, last.pop(session), text))
        if unclear:
            last[session] = text
    return sorted(out)


def test_pending_requests_with_late_and_repeated_input_and_restarts(spark):
    r = random.Random(3)
    rows = messages(r, 50)
    feed = Feed(spark, COLUMNS, lambda s: K.stream_pending(s, "1 hour"), "append")
    for part in parted(r, rows, 3):
        feed.go(timed(spark, part))
    assert feed.rows().count() == 0  # the watermark has passed none
    feed.go(timed(spark, [("end", 999, 999, 10_000, "", False)]))
    assert sorted(map(tuple, feed.rows().collect())) == answered(rows) != []
    feed.go(timed(spark, rows[:10]))  # far too late: left out
    feed.go(timed(spark, [("end", 1000, 1000, 20_000, "", False)]))
    assert sorted(map(tuple, feed.rows().collect())) == answered(rows)


def test_requests_are_forgotten_after_a_while(spark):
    rows = [("a", 1, 1, 0, "draw", True), ("a", 2, 2, 5, "a cat", False), ("b", 3, 3, 0, "draw", True), ("b", 4, 4, 500, "too late", False)]
    feed = Feed(spark, COLUMNS, lambda s: K.stream_pending(s, "1 second", patience_ms=60_000), "append")
    feed.go(timed(spark, rows))
    feed.go(timed(spark, [("end", 9, 9, 10_000, "", False)]))
    assert [tuple(r) for r in feed.rows().collect()] == [(2, "a", "draw", "a cat")]


def test_pending_equals_the_batch_operator(spark):
    rows = messages(random.Random(5), 40)
    batch = T.pending_images(spark.createDataFrame(timed(spark, rows), COLUMNS), F.when(F.col("unclear"), "ambiguous").otherwise(""), F.col("unclear"))
    assert sorted(map(tuple, batch.collect())) == answered(rows)


def test_a_batch_that_is_written_again_is_written_over(spark):
    feed = Feed(spark, "key string, at long, text string", lambda s: K.stream_latest(s, "key", "at"))
    feed.go([("a", 1, "x")])
    spark.createDataFrame([("a", 0, "half")], "key string, at long, text string").write.mode("append").parquet(f"{feed.out}/batch=1")
    feed.go([("a", 2, "y")])
    assert [tuple(r) for r in feed.last("key").collect()] == [("a", 2, "y")] and feed.rows().count() == 2


def test_latest_rows_need_no_python_for_each_key(spark):
    """A call for each key took most of the query's time."""
    path = scratch_path(spark, "in")
    spark.createDataFrame([("a", 1, "x")], "key string, at long, text string").write.parquet(path)
    found = K.stream_latest(spark.readStream.schema("key string, at long, text string").parquet(path), "key", "at")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "Python" not in plan
