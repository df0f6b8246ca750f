import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators.sketches import DISTINCT_K, estimates, merged, sketched
from lectern.operators.variants import fields, merged_schema, parsed, profile
from lectern.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = [(f"g{i % 3}", i % 30, r.randrange(4000) * (1 + i % 3), r.lognormvariate(0, 2), r.choice("aaaabbbccd") + str(r.randrange(3))) for i in range(60_000)]
    return data, spark.createDataFrame(data, "g string, day int, user int, value double, word string").repartition(8)


def test_merged_sketches_lie_within_their_bounds(rows):
    data, df = rows
    days = sketched(df, ["g", "day"], "user", "value", "word")
    for keys in (["g"], []):
        for row in estimates(merged(days, keys), keys).collect():
            own = [x for x in data if not keys or x[0] == row.g]
            exact = len({x[2] for x in own})
            assert row.n == len(own) and abs(row.distinct - exact) <= 3 * 1.04 / 2 ** (DISTINCT_K / 2) * exact
            values = np.sort([x[3] for x in own])
            for q, got in ((0.5, row.q50), (0.9, row.q90)):
                assert abs(np.searchsorted(values, got) / len(values) - q) <= 0.02
            counts = Counter(x[4] for x in own)  # fewer values than are tracked: exact
            assert [(t["item"], t["count"]) for t in row.top] == [(w, counts[w]) for w in [t["item"] for t in row.top]]
            assert sorted((t["count"] for t in row.top), reverse=True) == [n for _, n in counts.most_common(3)]


def test_merging_in_steps_counts_as_merging_at_once(rows):
    _, df = rows
    days = sketched(df, ["g", "day"], "user", "value", "word")
    once = estimates(merged(days, []), []).first()
    steps = estimates(merged(merged(days, ["g"]), []), []).first()
    assert (once.n, once.distinct) == (steps.n, steps.distinct)


def test_sketches_are_stored_and_added_to(spark, rows, tmp_path):
    _, df = rows
    for day in range(3):
        sketched(df.where(F.col("day") == day), ["g", "day"], "user", "value", "word").write.mode("append").parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    exact = df.where("day < 3").agg(F.countDistinct("user")).first()[0]
    assert stored.count() == 3  # day % 3 is the group
    assert estimates(merged(stored, []), []).first().distinct == pytest.approx(exact, rel=0.05)


def test_empty_groups_and_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, 5, 2.0, "x"), (2, None, None, None)], "g int, user int, value double, word string")
    got = {r.g: r for r in estimates(merged(sketched(df, ["g"], "user", "value", "word"), ["g"]).where("g = 1"), ["g"]).collect()}
    assert (got[1].n, got[1].distinct, got[1].q50) == (2, 1, 2.0)
    assert sketched(df.limit(0), ["g"], "user", "value", "word").count() == 0


def test_the_report_reads_the_events_once(spark):
    plan = registry.QUERIES["sketch_report"](spark, SF)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1 and "Python" not in plan


def test_fields_and_kinds(spark):
    texts = ['{"a": 1, "b": "x", "c": null}', '{"a": 1.5, "b": [1, "y"], "d": {"e": true}}', '{"a": 99999999999999999999, "b": false}', "[1, 2]", "7", "{broken", None, "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", parsed(F.col("text")).alias("v"))
    got = sorted((r.i, r.key, r.type) for r in fields(df, "v", ["i"]).collect())
    assert [x[:2] for x in got] == [(0, "a"), (0, "b"), (0, "c"), (1, "a"), (1, "b"), (1, "d"), (2, "a"), (2, "b")]
    kinds = sorted((r.key, r.kind, r.n) for r in profile(df, "v", []).collect())
    assert kinds == [("a", "number", 3), ("b", "array", 1), ("b", "boolean", 1), ("b", "string", 1), ("c", "null", 1), ("d", "object", 1)]


def test_one_schema_for_all(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 2.5, "b": "x"}',)], "text string").select(parsed(F.col("text")).alias("v"))
    assert "b: STRING" in merged_schema(df, "v", []).first().schema
