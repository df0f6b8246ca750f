import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieval as V
from lectern.operators import turns as T

TYPES = "vec_id long, embedding array<{}>"


def plain(vectors, queries, k, metric):
    score = {
        "dot": lambda a, b: float(np.dot(a, b)),
        "cosine": lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)),
        "l2": lambda a, b: 0.0 - float(np.linalg.norm(a - b)),
    }[metric]
    out = []
    for q, y in queries:
        best = sorted((-round(score(np.array(x), np.array(y)), 6), v) for v, x in vectors)[:k]
        out += [(q, v, -s + 0.0, i) for i, (s, v) in enumerate(best, 1)]
    return sorted(out)


def some(n, dims=8, kind="float", ties=True):
    r = np.random.default_rng(n)
    x = r.standard_normal((n, dims)).astype(np.float32 if kind == "float" else np.float64)
    if ties:
        x[n // 2 :] = x[: n - n // 2]  # every vector twice
    return [(int(i), [float(v) for v in row]) for i, row in zip(r.permutation(n), x)]


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_equals_all_pairs(spark, monkeypatch, metric, kind):
    monkeypatch.setattr(V, "PASS", 2000)
    monkeypatch.setattr(V, "BLOCK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        vectors = some(301, kind=kind)
        df = spark.createDataFrame(vectors, TYPES.format(kind)).repartition(5)
        queries = df.where("vec_id % 5 = 0")
        for k in (1, 4, 400):
            got = sorted((r.query_id, r.vec_id, round(r.score, 6) + 0.0, r.rank) for r in V.nearest(df, queries, k, metric).collect())
            want = plain(vectors, [v for v in vectors if v[0] % 5 == 0], k, metric)
            assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
            assert max(abs(a[2] - b[2]) for a, b in zip(got, want)) < 2e-6
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_tiles_of_a_frame_give_what_the_frame_gives(monkeypatch, metric):
    r = np.random.default_rng(3)
    x, ids = np.repeat(r.standard_normal((60, 4)), 5, axis=0), r.permutation(300)
    x[7] = 0
    y = x[::9]
    whole = V._best(ids, V.SCORES[metric](x, y), 9)
    for tile in (1, 8, 70, 299):
        monkeypatch.setattr(V, "TILE", tile)
        tiled = V._best_by_tiles(V.SCORES[metric], x, y, ids, 9)
        row = lambda found: sorted(zip(found[0].tolist(), found[1].tolist(), np.nan_to_num(found[2], nan=-9).round(6).tolist()))
        assert row(tiled) == row(whole)


def test_a_task_scores_few_pairs_at_a_time(monkeypatch):
    sizes = []
    score = lambda x, y: sizes.append(len(x) * len(y)) or V.SCORES["l2"](x, y)
    x = np.random.default_rng(1).standard_normal((10_000, 4))
    V._best_by_tiles(score, x, x[:256], np.arange(10_000), 6)
    assert sum(sizes) == 2_560_000 and max(sizes) <= 256 * 2048


def test_nulls_and_empty_sides(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0])], TYPES.format("float"))
    assert sorted((r.query_id, r.vec_id) for r in V.nearest(df, df, 5).collect()) == [(1, 1), (1, 3), (3, 1), (3, 3)]
    assert V.nearest(df, df.limit(0), 3).count() == 0 == V.nearest(df.limit(0), df, 3).count()


def test_few_rows_leave_the_frames(spark):
    df = spark.createDataFrame(some(2000, ties=False), TYPES.format("float")).repartition(4)
    rows = V.nearest(df, df.where("vec_id < 100"), 3)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and plan.count("MapInArrow") == 3
    assert rows.count() == 300


@pytest.mark.parametrize("limit", [50, 12_000])
def test_buffers_of_a_key_with_very_many_parts(spark, limit):
    parts = [(1, i, f"n{i}", "x" * (i % 9)) for i in range(3000)] + [(2, 1, "only", None)]
    rows = spark.createDataFrame(parts, "k int, at int, name string, text string").repartition(6)
    want = "\n\n".join(f"--- Document: n{i} ---\n" + "x" * (i % 9) for i in range(3000))[:limit]
    assert {r.k: r.buffer for r in T.document_buffers(rows, "k", "at", "name", "text", limit).collect()} == {1: want, 2: "--- Document: only ---\n"[:limit]}
    read = rows.withColumn("kind", F.lit("Document"))
    want = "\n\n".join(f"--- Document: n{i} ---\n{'x' * (i % 9)}".rstrip() for i in range(3000))[:limit]
    assert {r.k: r.buffer for r in T.session_buffers(read, "k", "at", limit).collect()}[1] == want
    plan = T.document_buffers(rows, "k", "at", "name", "text", limit)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
