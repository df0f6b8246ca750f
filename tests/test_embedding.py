import pytest
from pyspark.sql import functions as F

from lectern.operators.embedding import DIMENSIONS, embedded, letter_model


def absent():
    raise ImportError("no such library")


def counting():
    """A model whose vectors tell the size of the batch that they came in."""
    return lambda texts: [[float(len(texts)), float(len(t))] for t in texts]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, None if i % 11 == 0 else "é" * (i % 7) + "text") for i in range(500)], "id int, text string").repartition(3).cache()


def test_vectors_do_not_hang_on_batches(spark, texts):
    want = None
    for batch, frame in ((1, 10_000), (64, 10_000), (64, 7), (1000, 100)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(frame))
        try:
            got = sorted((r.id, tuple(r.embedding), r.provider) for r in embedded(texts, ["letters"], batch=batch).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = want or got
        assert got == want and len(got) == 500 and len(got[1][1]) == DIMENSIONS
    assert dict((i, v) for i, v, _ in want)[0] == tuple([0.0] * DIMENSIONS)


def test_small_frames_fill_batches(spark, texts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = embedded(texts.coalesce(1), ["counting"], batch=64, providers={"counting": counting}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = [r.embedding[0] for r in rows]
    assert sizes.count(64.0) == 448 and sizes.count(float(500 % 64)) == 500 % 64


def test_the_next_provider_takes_over(texts):
    providers = {"first": absent, "letters": letter_model}
    rows = embedded(texts, ["first", "letters"], providers=providers)
    assert {r.provider for r in rows.select("provider").distinct().collect()} == {"letters"}
    with pytest.raises(Exception, match="no such library"):
        embedded(texts, ["first"], providers={"first": absent}).collect()


def test_other_columns_stay_and_no_rows_need_no_model(texts):
    rows = embedded(texts.withColumn("extra", F.array(F.col("id"))), ["letters"])
    assert rows.columns == ["id", "text", "extra", "embedding", "provider"] and rows.where("extra[0] <> id").count() == 0
    assert embedded(texts.limit(0), ["first"], providers={"first": absent}).collect() == []


def test_a_model_that_loses_texts_is_an_error(texts):
    with pytest.raises(Exception, match="gave 1 vectors for"):
        embedded(texts, ["bad"], providers={"bad": lambda: lambda ts: [[1.0]]}).collect()
