"""Joins of points with intervals, and of intervals with each other, without comparing all pairs.

Intervals are of levels by their length: of level k are those longer than 2^(k-1) and up to 2^k times the narrowest bucket, and they lie in buckets of that width. So an
interval of any length lies in two buckets at most, and a point looks into one bucket of each level that occurs. The join is on equal buckets (and keys, where there
are any), and the exact condition is checked behind it: Spark hashes or sorts it, and no nested loop is needed.

A bucket with very many points is dealt to shares: its points by hash, its intervals to each of the shares, so that no task has all of it.

Where pairs are only counted or summed up, none is made: ``sums_within`` and ``overlap_counts`` take differences of running sums, and their work grows as the rows do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.sources.scratch import scratch_path

#: Width of the narrowest buckets, in the unit of the values.
WIDTH = 1.0
#: Levels of intervals that occur at most: 2^60 times the narrowest width; longer ones are of the last.
LEVELS = 60
#: Points of one bucket in one share, on average.
CROWD = 100_000
#: Crowded buckets at most; with so many points that more would be, the shares are larger.
CROWDED = 100_000


def seconds(at: Column) -> Column:
    """A time as exact seconds, to be joined on."""
    return F.unix_micros(at.cast("timestamp")) / F.lit(1_000_000)


def level_of(length: Column, width: float) -> Column:
    """The level of an interval; 0 for those no longer than ``width``."""
    level = F.ceil(F.log2(F.greatest(length, F.lit(width)) / width))
    return F.least(level, F.lit(LEVELS)).cast("int")


def bucket_of(value: Column, level: Column, width: float) -> Column:
    return F.floor(value / (width * F.pow(F.lit(2.0), level))).cast("long")


def bucketed(intervals: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """``intervals`` with level__ and bucket__, once for each bucket that they reach; those without a bound, or that end before they start, hold nothing and go."""
    own = intervals.where(F.col(start) <= F.col(end)).withColumn("level__", level_of(F.col(end) - F.col(start), width))
    first, last = (bucket_of(F.col(c), F.col("level__"), width) for c in (start, end))
    return own.withColumn("bucket__", F.explode(F.sequence(first, last)))


def with_points(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, keys: list[str] | None = None, width: float = WIDTH, crowd: int = CROWD) -> DataFrame:
    """All columns of both for each pair of an interval and a point with ``start`` <= ``at`` <= ``end`` and equal ``keys``.

    Bounds and points are numbers (``seconds`` makes them of times). Null bounds, points and keys meet nothing. The columns of the two have different names, but for the keys.
    """
    keys = keys or []
    whole = intervals.where(F.col(start) <= F.col(end))
    levels = whole.agg(F.collect_set(level_of(F.col(end) - F.col(start), width))).scalar()  # LEVELS + 1 values at most
    known = points.where(F.col(at).isNotNull())
    looked = known.withColumn("level__", F.explode(levels)).withColumn("bucket__", bucket_of(F.col(at), F.col("level__"), width))
    place = [*keys, "level__", "bucket__"]
    # no more than CROWDED buckets can hold this many points, so their list may go to all tasks
    all_ = known.agg(F.count("*")).scalar() * F.size(levels)
    most = F.greatest(F.lit(crowd).cast("long"), F.ceil(all_ / CROWDED))
    counts = looked.groupBy(*place).agg(F.count("*").alias("n__")).where(F.col("n__") > most)
    crowded = F.broadcast(counts.select(*place, F.ceil(F.col("n__") / most).alias("shares__")))
    shares = F.coalesce("shares__", F.lit(1).cast("long"))
    dealt = looked.join(crowded, place, "left").withColumn("share__", F.pmod(F.xxhash64(at, *[c for c in points.columns if c not in keys]), shares)).drop("shares__")
    sent = bucketed(intervals, start, end, width).join(crowded, place, "left").withColumn("share__", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("shares__")
    pairs = sent.join(dealt, [*place, "share__"]).where(F.col(at).between(F.col(start), F.col(end)))
    return pairs.drop("level__", "bucket__", "share__")


def overlapping(left: DataFrame, right: DataFrame, bounds: tuple[str, str], others: tuple[str, str], keys: list[str] | None = None, width: float = WIDTH, crowd: int = CROWD) -> DataFrame:
    """All columns of both for each pair of intervals that share a point, and have equal ``keys``.

    Of two that overlap, one starts in the other: the right one in the left one, or later than it the left one in the right one. So the pairs are those of two joins of points with intervals.
    """
    inside = with_points(left, right.where(F.col(others[0]) <= F.col(others[1])), *bounds, others[0], keys, width, crowd)
    around = with_points(right, left.where(F.col(bounds[0]) <= F.col(bounds[1])), *others, bounds[0], keys, width, crowd).where(F.col(others[0]) < F.col(bounds[0]))
    return inside.unionByName(around)


def running(marks: DataFrame, at: str, names: list[str]) -> DataFrame:
    """For each value of ``at`` in ``marks``: sums of ``names`` over all rows of lesser values (name_before), and with its own (name_through).

    Equal values are one row first. Ranges of values are summed each by itself, and shifted by what lies before; they are stored, so that they are the same for both.
    """
    each = marks.where(F.col(at).isNotNull()).groupBy(at).agg(*[F.sum(n).alias(n) for n in names])
    ranged = each.repartitionByRange(at).withColumn("part__", F.spark_partition_id())
    path = scratch_path(marks.sparkSession, "running")
    ranged.write.parquet(path)
    held = marks.sparkSession.read.schema(ranged.schema).parquet(path)
    # one row for each range
    lower = W.orderBy("first__").rowsBetween(W.unboundedPreceding, -1)
    parts = held.groupBy("part__").agg(F.min(at).alias("first__"), *[F.sum(n).alias(n) for n in names])
    shifts = parts.select("part__", *[F.coalesce(F.sum(n).over(lower), F.lit(0)).alias(f"{n}__") for n in names])
    own = W.partitionBy("part__").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    through = held.select(at, "part__", *names, *[F.sum(n).over(own).alias(f"{n}_own") for n in names]).join(F.broadcast(shifts), "part__")
    sums = [(F.col(f"{n}_own") + F.col(f"{n}__") - less).alias(f"{n}_{kind}") for n in names for kind, less in (("before", F.col(n)), ("through", F.lit(0)))]
    return through.select(at, *sums)


def sums_within(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, names: list[str]) -> DataFrame:
    """``intervals`` with the sums of the points' whole numbers ``names`` over the points with ``start`` <= ``at`` <= ``end``; 0 where none lies in it.

    Intervals without a bound, or that end before they start, go; points without a place aren't counted.
    """
    whole = intervals.where(F.col(start) <= F.col(end))
    none = [F.lit(0).cast("long").alias(n) for n in names]
    marks = points.select(F.col(at).alias("at__"), *[F.col(n).cast("long").alias(n) for n in names])
    for bound in (start, end):
        marks = marks.unionByName(whole.select(F.col(bound).alias("at__"), *none))
    sums = running(marks, "at__", names)
    before = sums.select(F.col("at__").alias(start), *[F.col(f"{n}_before") for n in names])
    through = sums.select(F.col("at__").alias(end), *[F.col(f"{n}_through") for n in names])
    out = whole.join(before, start).join(through, end)
    return out.select(*intervals.columns, *[(F.col(f"{n}_through") - F.col(f"{n}_before")).alias(n) for n in names])


def overlap_counts(intervals: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """``intervals`` with the number of all intervals that share a point with each, itself among them: those that start no later than it ends, without those that end before it starts."""
    whole = intervals.where(F.col(start) <= F.col(end))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    marks = whole.select(F.col(start).alias("at__"), one.alias("starts"), none.alias("ends")).unionByName(whole.select(F.col(end).alias("at__"), none.alias("starts"), one.alias("ends")))
    sums = running(marks, "at__", ["starts", "ends"])
    before = sums.select(F.col("at__").alias(start), "ends_before")
    through = sums.select(F.col("at__").alias(end), "starts_through")
    out = whole.join(before, start).join(through, end)
    return out.select(*intervals.columns, (F.col("starts_through") - F.col("ends_before")).alias(name))
