import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprints
from lectern.llm.fingerprints import canonical, with_edits, with_fingerprints

TEXTS = ["", "A b", "a  B\n", "ﬁ Ａb Straße ΣΑΣ", "FI AB strasse σας", "é", "é", "É ", "x" * 50, None, " \x85 ", "日本語 テキスト", "a\x1fb", "a b"]


def plain(text):
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(re.split(r"[\s\x1c-\x1f\x85]+", text)).strip(" ")


def test_canonical(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").select("i", canonical(F.col("text")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: plain(t) for i, t in enumerate(TEXTS)}


@pytest.fixture(params=["wide", "weak"])
def digests(request, monkeypatch):
    if request.param == "weak":  # digests that collide all the time
        monkeypatch.setattr(fingerprints, "digest", lambda c: F.pmod(F.length(c), F.lit(3)).cast("string"))


def test_equal_fingerprints_mean_equal_texts(spark, digests):
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate(TEXTS + TEXTS[:3])], "doc_id long, text string, fingerprint string, digest int")
    rows = with_fingerprints(docs).collect()
    assert len(rows) == len(TEXTS) + 3
    for a in rows:
        for b in rows:
            assert (a.fingerprint == b.fingerprint) == (plain(a.text) == plain(b.text))


@pytest.mark.parametrize("step", [1, 40, 7_000_000])
def test_edits(spark, digests, step):
    texts = [*TEXTS, *(f"doc {i} é " * (i % 7) for i in range(150))]
    rows = [(5 + i * step, t, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5)
    got = {r.doc_id: r for r in with_edits(docs).collect()}
    assert len(got) == len(rows)
    for i, (doc, text, _) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.near_edited == float(plain(text) == plain(edit)) and r.near_next == float(plain(text) == plain(after))
        assert (r.fingerprint == r.edited_fingerprint) >= (plain(text) == plain(edit))


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, "cd"), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.near_next) for r in with_edits(docs).collect()) == [(0, 0.0), (1, 0.0), (1, 1.0), (2, 0.0)]
    assert with_edits(docs.limit(0)).count() == 0 and with_fingerprints(docs.limit(0)).count() == 0
