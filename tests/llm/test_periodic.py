import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm.periodic import collapsed, greatest_run, looped, op11_runs, periodic_runs
from lectern.llm.tandem import Extensions, Tree, blocks, covering, previous_factors, primitive, runs_of


def plain(words, least=6, exponent=4):
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(least, exponent * q) and not any(q % d == 0 and own[d:] == own[:-d] for d in range(1, q)):
                out.append((i, len(own), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def some(r):
    n = r.randint(0, r.choice([5, 20, 60]))
    letters = [b"abcd"[x : x + 1] for x in (r.randrange(r.choice([1, 2, 3, 4])) for _ in range(n))]
    if n > 3 and r.random() < 0.5:
        p, s = r.randint(1, max(1, n // 3)), r.randrange(n)
        letters = [letters[s + (i - s) % p] if i >= s else w for i, w in enumerate(letters)]
    return letters


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (4, 3), (9, 2)])
def test_runs_equal_all_periods_tried(least, exponent):
    r = random.Random(least * exponent)
    for _ in range(500):
        texts = [some(r) for _ in range(r.randint(1, 4))]
        assert runs_of(texts, least, exponent) == [plain(t, least, exponent) for t in texts]


@pytest.mark.parametrize("text", ["a " * 3000, "a b " * 1500 + "c " * 1500, " ".join(map(str, range(5000))) + " 1 2 3" * 1000])
def test_very_periodic_texts(text):
    words = text.encode().split()
    assert runs_of([words, words]) == [plain(words)] * 2


def test_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert runs_of([b], 2, 2) == [plain(b, 2, 2)] and len(plain(b, 2, 2)) > 100


def test_covering_squares_and_walks_give_the_whole_vocabulary():
    r = random.Random(2)
    for _ in range(200):
        words = np.array([r.randrange(2) for _ in range(r.randint(2, 40))])
        n = len(words)
        squares = {(tuple(words[i : i + 2 * k]), k) for k in range(1, n // 2 + 1) for i in range(n - 2 * k + 1) if (words[i : i + k] == words[i + k : i + 2 * k]).all()}
        kinds = {(s, k) for s, k in squares if not any(k % d == 0 and s[d:] == s[:-d] for d in range(1, k))}
        ext = Extensions(words, np.zeros(n, int))
        ext.finish()
        order = np.argsort(ext.grams)
        common = np.concatenate([[0], ext.forward(order[:-1], order[1:])])
        tree = Tree(np.unique(words, return_inverse=True)[1], order, common)
        factors = [max([next((d for d in range(n - i + 1) if i + d == n or words[i + d] != words[j + d])) for j in range(i)], default=0) for i in range(n)]
        assert previous_factors(order.tolist(), common.tolist()) == factors
        start, k = covering(ext, *blocks(factors, [0, n]))
        ok = primitive(ext, start, k)
        found = {(tuple(words[tree.order[tree.left[v]] :][: 2 * q]), q) for v, q in tree.vocabulary(start[ok], k[ok])}
        assert found == kinds


def test_collapsed():
    words = b"x a b a b a b a b y".split()
    assert collapsed(words, plain(words)) == b"x a b y" and collapsed([], []) == b"" and collapsed(words, []) == b" ".join(words)


def test_exponents_under_two_are_refused():
    with pytest.raises(ValueError):
        runs_of([[b"a"]], 6, 1)


def test_edge_cases(spark):
    rows = [(1, None, 1), (None, "a " * 9, 1), (3, " \t\n", 1), (4, "a\x0ba\ra a a a é", 1), (4, "a\x0ba\ra a a a é", 1), (5, "ü " * 100_000, 2), (6, "one", 3), (7, "a\x85a\x85a\x85a\x85a\x85a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert periodic_runs(docs).count() == 8 and periodic_runs(docs.limit(0)).collect() == []
    assert got[1].runs == [] and got[1].collapsed == "" and got[3].n_words == 0 and got[6].collapsed == "one"
    assert [tuple(r) for r in got[None].runs] == [(0, 9, 1)] and [tuple(r) for r in got[4].runs] == [(0, 6, 1)] and got[4].collapsed == "a é"
    assert [tuple(r) for r in got[5].runs] == [(0, 100_000, 1)] and got[5].collapsed == "ü" and got[7].runs == []


def test_greatest_run_is_exact(spark):
    runs = [[(0, 13, 3), (4, 9, 2), (9, 18, 4), (20, 9, 2)], [], [(5, 4 * 10**9 + 1, 10**9), (0, 4 * 10**9 + 2, 10**9 + 1)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = {r.i: r.best for r in df.select("i", greatest_run(F.col("runs")).alias("best")).collect()}
    for i, own in enumerate(runs):
        want = min(own, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if own else None
        assert (tuple(got[i]) if got[i] else None) == want


def looped_words(i, words):
    h, n = zlib.crc32(str(i).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]


def test_looped(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 23))) for i in range(400)] + [(None, "a b"), (10, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", looped(F.col("doc_id"), F.col("text")).alias("new")).collect()
    assert all((r.new or "").split() == looped_words(r.doc_id, (r.text or "").split()) for r in got if r.doc_id is not None)
    assert [r.new for r in got if r.doc_id is None] == ["a b"]


def test_query_equals_a_plain_loop(spark, small):
    rows = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in op11_runs(spark, small).collect()}
    assert len(got) == len(rows)
    digest = lambda s: hashlib.sha256(s).hexdigest()
    some_run = 0
    for row in rows:
        words = looped_words(row["doc_id"], (row["text"] or "").encode().split())
        runs, r = plain(words), got[row["doc_id"]]
        some_run += bool(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode())
        assert r.collapsed_sha256 == digest(b" ".join(w for i, w in enumerate(words) if i not in gone))
    assert some_run > 5
