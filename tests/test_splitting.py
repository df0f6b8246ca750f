import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions.folds import BLOCK, everything, folded, gathered, gathered_all
from lectern.operators.splitting import recursive_spans, recursive_windows, split_documents

SF = "/root/testdata/sf0.01"


def plain(text, size=1500, overlap=300, separators=("\n\n", "\n", " ", "")):
    """The windows by lists of strings, one recursion for each separator."""
    out, held = [], []

    def close():
        whole = "".join(held).strip()
        if whole:
            out.append(whole)

    sep, finer = separators[0], separators[1:]
    parts = text.split(sep) if sep else list(text)
    for piece in [p for p in (parts[:1] + [sep + p for p in parts[1:]]) if p]:
        if sep and len(piece) >= size:
            close()
            held = []
            out += plain(piece, size, overlap, finer)
            continue
        if sum(map(len, held)) + len(piece) > size:
            close()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                held = held[1:]
        held.append(piece)
    close()
    return out


def some_text(r):
    kinds = ["a", "bb", "ccc dd", " ", "\n", "\n\n", "\n\n\n", "é", "x" * 30, "\t", " \n ", "word", "two words", "\x1c", " "]
    return "".join(r.choice(kinds) for _ in range(r.randint(0, 60)))


@pytest.mark.parametrize("size, overlap", [(10, 3), (12, 0), (7, 6), (20, 10), (1500, 300)])
def test_windows_equal_plain_lists(spark, size, overlap):
    r = random.Random(size)
    texts = [some_text(r) for _ in range(400)] + ["", " ", "\n\n", "x" * 100, "a" * size, "a" * (size + 1), "a " * 50, ("b" * size + "\n") * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    got = {r.i: r.w for r in rows.select("i", recursive_windows(F.col("text"), size, overlap).alias("w")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain(text, size, overlap), text


def test_null_text_and_bad_overlap(spark):
    rows = spark.createDataFrame([(1, None)], "i int, text string")
    assert rows.select(recursive_windows(F.col("text")).alias("w")).first().w == []
    with pytest.raises(ValueError):
        recursive_windows(F.col("text"), 10, 10)
    with pytest.raises(ValueError):
        recursive_spans(F.col("text"), 10, -1)


def test_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {}
    for row in split_documents(docs, ["doc_id"]).orderBy("doc_id", "at").collect():
        got.setdefault(row.doc_id, []).append(row.part)
    assert got == {i: plain(t) for i, t in texts.items() if plain(t)} and sum(map(len, got.values())) > 2000


def test_windows_lie_in_the_text_and_cover_it(spark):
    r = random.Random(9)
    text = "".join(r.choice(["word ", "longer-word ", "\n", "\n\n"]) for _ in range(3000))
    spans = spark.createDataFrame([(text,)], "text string").select(recursive_spans(F.col("text"), 200, 50).alias("s")).first().s
    covered = set()
    for s in spans:
        assert s.n <= 200
        covered |= set(range(s.at, s.at + s.n))
    assert covered == set(range(len(text)))


def test_work_grows_with_the_text(spark):
    """Eight times the text takes no sixty-four times as long."""
    took = []
    for n in (250_000, 2_000_000):
        rows = spark.createDataFrame([("some words of a line\n" * (n // 21),)], "text string")
        rows.select(F.size(recursive_windows(F.col("text"))).alias("n")).collect()
        began = time.perf_counter()
        assert rows.select(F.size(recursive_windows(F.col("text"))).alias("n")).first().n > n // 1500
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * max(took[0], 0.3)


def test_no_python_and_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = split_documents(docs, ["doc_id"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("n", [0, 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7])
def test_folds_gather_all_in_order(spark, n):
    items = F.filter(F.sequence(F.lit(1), F.lit(n + 1)), lambda x: x <= n)
    step = lambda s, x: F.struct(F.when(x % 5 == 0, gathered_all(s["held"], F.array(x, -x))).when(x % 7 == 0, s["held"]).otherwise(gathered(s["held"], x)).alias("held"), (s["total"] + x).alias("total"))
    fold = folded(items, "int", {"total": F.lit(0)}, step, lambda s: F.array_append(everything(s["held"]), s["total"]))
    want = [y for x in range(1, n + 1) for y in ((x, -x) if x % 5 == 0 else () if x % 7 == 0 else (x,))]
    assert spark.range(1).select(fold.alias("a")).first().a == [*want, sum(range(n + 1))]
