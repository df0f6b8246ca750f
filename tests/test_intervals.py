import random

import pytest
from pyspark.sql import functions as F

from lectern.operators.intervals import bucketed, level_of, overlap_counts, overlapping, sums_within, with_points

INTERVALS = "i int, k string, a double, b double"
POINTS = "p int, k string, x double"


def some(r, n):
    spans = [0.0, 0.1, 1.0, 1.5, 7.0, 64.0, 100.0, 5000.0]
    intervals = [(i, r.choice("uv"), (a := r.choice([r.uniform(-50, 150), float(r.randint(-5, 100))])), a + r.choice([*spans, r.uniform(0, 9)])) for i in range(n)]
    points = [(p, r.choice("uv"), r.choice([r.uniform(-60, 200), float(r.randint(-5, 100)), intervals[p % n][2], intervals[p % n][3]])) for p in range(n)]
    return [*intervals, (900, "u", None, 1.0), (901, "u", 1.0, None), (902, None, 0.0, 9.0), (903, "v", 9.0, 1.0)], [*points, (900, "u", None), (901, None, 3.0)]


@pytest.mark.parametrize("width, crowd", [(1.0, 100_000), (0.5, 3), (50.0, 10)])
def test_points_in_intervals_equal_all_pairs(spark, width, crowd):
    intervals, points = some(random.Random(int(width * 2)), 60)
    left, right = spark.createDataFrame(intervals, INTERVALS), spark.createDataFrame(points, POINTS)
    own = lambda i, p: None not in (i[2], i[3], p[2]) and i[2] <= p[2] <= i[3]
    rows = with_points(left, right.drop("k"), "a", "b", "x", width=width, crowd=crowd)
    assert sorted((r.i, r.p) for r in rows.collect()) == sorted((i[0], p[0]) for i in intervals for p in points if own(i, p))
    keyed = with_points(left, right, "a", "b", "x", ["k"], width, crowd)
    assert sorted((r.i, r.p) for r in keyed.collect()) == sorted((i[0], p[0]) for i in intervals for p in points if own(i, p) and i[1] == p[1] is not None)


def test_overlaps_equal_all_pairs(spark):
    intervals, _ = some(random.Random(8), 60)
    left = spark.createDataFrame(intervals, INTERVALS)
    right = left.select(F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    whole = [x for x in intervals if None not in x[2:] and x[2] <= x[3]]
    rows = overlapping(left, right, ("a", "b"), ("c", "d"), width=2.0, crowd=20)
    assert sorted((r.i, r.j) for r in rows.collect()) == sorted((x[0], y[0]) for x in whole for y in whole if x[2] <= y[3] and y[2] <= x[3])


def test_an_interval_of_any_length_lies_in_two_buckets_at_most(spark):
    lengths = [0.0, 1e-9, 0.5, 1.0, 1.0000001, 2.0, 3.0, 1e6, 1e15, 1e300]
    rows = spark.createDataFrame([(i, 0.7, 0.7 + n) for i, n in enumerate(lengths[:-1])], "i int, a double, b double")
    assert bucketed(rows, "a", "b", 1.0).groupBy("i").count().agg(F.max("count")).first()[0] <= 2
    levels = spark.createDataFrame([(n,) for n in lengths], "n double").select(level_of(F.col("n"), 1.0).alias("l")).collect()
    assert [r.l for r in levels] == [0, 0, 0, 0, 1, 1, 2, 20, 50, 60]


def test_empty_sides(spark):
    left, right = spark.createDataFrame([], INTERVALS), spark.createDataFrame([(1, "u", 2.0)], POINTS)
    assert with_points(left, right.drop("k"), "a", "b", "x").count() == 0
    assert with_points(spark.createDataFrame([(1, "u", 1.0, 3.0)], INTERVALS), right.drop("k").limit(0), "a", "b", "x").count() == 0


def test_no_nested_loop_and_no_whole_product(spark):
    rows = with_points(spark.createDataFrame([(1, "u", 1.0, 3.0)], INTERVALS), spark.createDataFrame([(1, "u", 2.0)], POINTS).drop("k"), "a", "b", "x")
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sums_and_counts_equal_all_pairs(spark):
    intervals, points = some(random.Random(4), 200)
    left, right = spark.createDataFrame(intervals, INTERVALS), spark.createDataFrame(points, POINTS).withColumn("odd", F.col("p") % 2).withColumn("n", F.lit(1))
    whole = [x for x in intervals if None not in x[2:] and x[2] <= x[3]]
    inside = {x[0]: [p[0] for p in points if p[2] is not None and x[2] <= p[2] <= x[3]] for x in whole}
    got = sums_within(left, right, "a", "b", "x", ["n", "odd"]).collect()
    assert sorted((r.i, r.n, r.odd) for r in got) == sorted((i, len(ps), sum(p % 2 for p in ps)) for i, ps in inside.items())
    got = overlap_counts(left, "a", "b", "n").collect()
    assert sorted((r.i, r.n) for r in got) == sorted((x[0], sum(x[2] <= y[3] and y[2] <= x[3] for y in whole)) for x in whole)


def test_counting_makes_no_pairs(spark):
    """Intervals that all overlap: the pairs would be a million, and what is shuffled and joined is as many rows as there are intervals."""
    left = spark.range(1000).select("id", (F.col("id") / 1000).alias("a"), (F.col("id") / 1000 + 5).alias("b"))
    rows = overlap_counts(left, "a", "b", "n")
    assert {r.n for r in rows.collect()} == {1000}
    plan = rows._jdf.queryExecution().optimizedPlan()
    assert "explode" not in plan.toString() and "bucket__" not in plan.toString()


def test_sessions_at_once_makes_no_pairs(spark, monkeypatch):
    import __spark_entry__ as entry
    from lectern.operators import intervals

    def pairs(*a, **k):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(intervals, "with_points", pairs)
    for name in ("sessions_at_once", "session_company"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
