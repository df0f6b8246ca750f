import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.sources import jsonl_files as W

ROWS = [(f"chunk-{i}", text, {"k": f"v{i}"} if i % 3 else None) for i, text in enumerate(["plain", "é ü 😀", 'quo"te \\ back', "two\nlines", "", None, "  sep", "x" * 3_000_000] * 5)]


@pytest.fixture
def session(spark):
    return W.registered(spark)


def written(session, path, rows=ROWS, mode="append", parts=4):
    session.createDataFrame(rows, W.SCHEMA).repartition(parts).write.format(W.NAME).mode(mode).option("path", path).save()


def read(session, path):
    return session.read.format(W.NAME).option("path", path).load()


@pytest.mark.parametrize("uri", [False, True])
def test_round_trip(session, tmp_path, uri):
    path = f"file://{tmp_path}/out" if uri else str(tmp_path / "out")
    written(session, path)
    assert sorted(map(str, read(session, path).collect())) == sorted(map(str, session.createDataFrame(ROWS, W.SCHEMA).collect()))
    files = os.listdir(tmp_path / "out")
    assert len(files) == 4 and all(f.startswith("part-") for f in files)
    assert read(session, path).rdd.getNumPartitions() == 4


def test_appended_and_overwritten(session, tmp_path):
    path = str(tmp_path / "out")
    written(session, path, ROWS[:10])
    written(session, path, ROWS[10:16])
    assert read(session, path).count() == 16
    written(session, path, ROWS[:3], "overwrite")
    assert sorted(r.id for r in read(session, path).collect()) == ["chunk-0", "chunk-1", "chunk-2"]


def batch(ids):
    return pa.RecordBatch.from_pydict({"id": ids, "text": ["t"] * len(ids), "metadata": [None] * len(ids)}, schema=pa.schema([("id", pa.string()), ("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))]))


def test_attempts_that_are_not_accepted_leave_nothing(session, tmp_path):
    path = str(tmp_path / "out")
    writer = W.JsonLinesWriter(path, False)
    lost = writer.write(iter([batch(["a", "b"])]))  # its executor is lost after this
    again = writer.write(iter([batch(["a", "b"])]))
    other = writer.write(iter([batch(["c"])]))
    assert lost.hidden != again.hidden and read(session, path).count() == 0  # nothing is seen before the commit
    writer.commit([again, None, other])
    assert sorted(r.id for r in read(session, path).collect()) == ["a", "b", "c"]
    assert len(os.listdir(path)) == 2


def test_a_failed_job_leaves_nothing(session, tmp_path):
    path = str(tmp_path / "out")
    written(session, path, ROWS[:2])
    broken = session.createDataFrame(ROWS[:8], W.SCHEMA).repartition(4).withColumn("id", F.when(F.col("id") == "chunk-3", F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format(W.NAME).mode("append").option("path", path).save()
    assert sorted(r.id for r in read(session, path).collect()) == ["chunk-0", "chunk-1"] and all(f.startswith("part-") for f in os.listdir(path))


def test_filters_on_ids_are_pushed_down(session, tmp_path):
    path = str(tmp_path / "out")
    written(session, path, [*ROWS[:7], ('odd "id" é', "x", None), ("other", '"id": "chunk-3"', None)])
    for wanted in (["chunk-3"], ["chunk-1", "chunk-4", "none"], ['odd "id" é']):
        rows = read(session, path).where(F.col("id").isin(wanted))
        assert sorted(r.id for r in rows.collect()) == sorted(set(wanted) - {"none"})
    reader = W.JsonLinesReader(path, session.createDataFrame([], W.SCHEMA).schema)
    assert list(reader.pushFilters([W.EqualTo(("id",), "a"), W.EqualTo(("text",), "b")])) == [W.EqualTo(("text",), "b")] and reader.ids == {"a"}


def test_an_empty_table(session, tmp_path):
    path = str(tmp_path / "out")
    session.createDataFrame([], W.SCHEMA).write.format(W.NAME).mode("append").option("path", path).save()
    assert read(session, path).collect() == []
