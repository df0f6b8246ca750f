import sys
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.llm.audit import OP12_SQL, audit_filters, cells, op12_audit, spectra

sys.path.insert(0, str(Path(__file__).parent.parent))
import compare  # noqa: E402

DOCS = "doc_id long, text string, lang string, mask string, n int, part string"
LABELS = "doc_id long, quality int, toxic int, good int"


def plain(docs, labels):
    rows, fails = [], []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        earlier = [j for j, t, _ in docs if (t or "") == text and j is not None]
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)}
        failed |= {"D": any(c in "#$%&*|" for c in text), "E": any(i is None or j < i for j in earlier)}
        fails.append((lang or "", {x for x in failed if failed[x]}, any(q == 1 for k, q, _ in labels if k == i and i is not None), any(t == 1 for k, _, t in labels if k == i and i is not None)))
    for part in {f[0] for f in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        every = {}
        for order in permutations("ABCDE"):
            for f, _, _ in own:
                for x in order:
                    if x in f:
                        every[x] = every.get(x, 0) + 1
                        break
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                out = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                hit = [r for r in own if x in r[0]]
                rows.append((part, "".join(order), step, len(left), len(out), len(hit) - len(out), sum(len(r[0]) == 1 for r in hit), sum(r[1] for r in out), sum(r[2] for r in out), every.get(x, 0)))
    return sorted(rows)


LONG = " ".join(f"w{i}" for i in range(250))
CASES = [
    [(1, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (4, "a " * 300, "en"), (5, LONG + " #", "fr"), (6, None, None), (7, "", ""), (8, "UP", "fr")],
    [(5, LONG, "en"), (5, LONG, "en"), (None, LONG, "en"), (None, "x", "en"), (None, "x", "en"), (9, "x y\x0bz", "en"), (9, "é" * 40 + "A", "en"), (7, LONG, "de")],
    [(3, "A" * 3 + "b" * 97, "en"), (4, "A" * 4 + "b" * 96, "en"), (6, "a b " * 100 + "c", "en"), (8, "&", "en"), (10, LONG * 300, "en"), (2, LONG * 300, "es")],
]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (4, 1, 0), (4, 1, 0)]


@pytest.mark.parametrize("docs", CASES)
def test_audit_equals_going_through_the_orders(spark, docs):
    own = spark.createDataFrame([(*d, "x", 3, "p") for d in docs], DOCS)
    labels = spark.createDataFrame([(*m, 0) for m in MARKS], LABELS)
    rows = audit_filters(own, labels)
    assert rows.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, rows.collect())) == plain(docs, MARKS)


def test_no_labels_and_no_documents(spark):
    own = spark.createDataFrame([(*d, "x", 3, "p") for d in CASES[0]], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert sorted(map(tuple, audit_filters(own, none).collect())) == plain(CASES[0], [])
    assert audit_filters(own.limit(0), none).collect() == []


def test_the_transform_is_inverted_exactly(spark):
    counts = [(m * 7919) % 1000 + (10**12 if m == 5 else 0) for m in range(32)]
    rows = spark.createDataFrame([("p", m, m % 2 == 0, m % 3 == 0, n) for m, n in enumerate(counts)], "part string, mask int, good boolean, toxic boolean, n long")
    got = spectra(rows).select(cells(F.col("every")).alias("every"), cells(F.col("good")).alias("good")).first()
    assert got.every == counts and got.good == [n if m % 2 == 0 else 0 for m, n in enumerate(counts)]


def test_query_equals_its_sql(spark, small):
    con, df = compare.duck(small), op12_audit(spark, small)
    assert compare.kinds(df, con, OP12_SQL) == {}
    assert compare.rows_of_spark(df) == compare.rows_of_duck(con, OP12_SQL)
