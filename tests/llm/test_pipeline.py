import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import similar, substrings
from lectern.llm.simhash import fingerprint
from lectern.llm.tokens import byte_encoder
from tests.llm.test_pii import brute as personal
from tests.llm.test_simhash import groups
from tests.llm.test_substrings import brute as repeated


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    r = random.Random(6)
    words = {"en": ["the", "and", "house", "with", "thing", "over", "think", "would"], "fr": ["les", "dans", "être", "où", "chose", "quelle", "voilà", "nous"]}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "", "s", "ly" if lang == "en" else "é"]) + str(r.randint(0, 9)) for _ in range(n))
    passage = text("en", 120)
    rows = [(i, text("en" if i % 3 else "fr", r.randint(40, 300)), "en" if i % 3 else "fr", "s", 0) for i in range(150)]
    rows += [(200, rows[5][1], "en", "s", 0), (201, rows[7][1].upper(), "en", "s", 0), (202, None, None, None, None), (203, "", "en", "s", 0), (204, "12 34", "fr", "s", 0)]
    rows += [(210 + i, f"{text('en', 60)} {passage} {text('en', 50)} reach me at me{i}@mail.example.org ok", "en", "s", 0) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("sf"))
    df.write.parquet(f"{path}/documents.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def test_stages_equal_brute_force(spark, docs):
    path, df = docs
    names = df.columns
    one = corpus_pipeline.language(spark, df, path)
    assert one.columns == names
    first = {r.doc_id: r for r in one.collect()}
    assert {202, 203, 204}.isdisjoint(first) and len(first) == df.count() - 3

    two = corpus_pipeline.near_dedup(spark, one, path)
    assert two.columns == names
    ids = sorted(first)
    want = {ids[g] for g in groups([fingerprint(first[i].text) for i in ids], 4)}
    second = {r.doc_id: r.text for r in two.collect()}
    assert set(second) == want and {200, 201}.isdisjoint(second)

    three = corpus_pipeline.repeats(spark, two, path)
    assert three.columns == names
    ids = sorted(second)
    cut = {i: kept.decode("utf-8", "ignore") for i, (kept, _, _) in zip(ids, repeated([second[i] for i in ids], 400))}
    third = {r.doc_id: r.text for r in three.collect()}
    assert third == {i: t for i, t in cut.items() if t.strip()}
    assert any(len(third[i]) < len(second[i]) for i in third)

    four = corpus_pipeline.personal_data(spark, three, path)
    assert four.columns == names
    for r in four.collect():
        text, at, made = third[r.doc_id], 0, ""
        for kind, a, b in sorted(personal(text), key=lambda s: s[1]):
            made, at = made + text[at:a] + f"[{kind.upper()}]", b
        made += text[at:]
        if r.doc_id < 200:
            assert r.text == made
        assert r.n_chars == len(r.text) and not re.search("@mail", r.text)

    texts = {r.doc_id: r.text for r in four.collect()}
    pieces = corpus_pipeline.packing(spark, four, path).collect()
    for doc, text in texts.items():
        ids = np.append(np.frombuffer(byte_encoder().encode(text), "<u4"), 1).astype("<u4")
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own]
        assert sum(p.length for p in own) == len(ids)


def test_run_equals_the_stages(spark, docs):
    path, df = docs
    whole = corpus_pipeline.run(spark, path)
    assert whole.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    step = df
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, path)
    key = lambda rows: sorted((r.doc_id, r.start, r.ids_crc32) for r in rows)
    assert key(whole.collect()) == key(step.collect())


def test_empty(spark, docs, tmp_path):
    path, df = docs
    df.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_takes_near_copies_of_similarity_0_8(spark):
    r = random.Random(8)
    rows, want = [], set()
    for i in range(40):
        words = [f"w{r.randint(0, 9999)}" for _ in range(r.randint(60, 900))]
        copy, far = list(words), list(words)
        for at in range(20, len(words), 60):  # 5 of 60 shingles differ at each
            copy[at] = "changed"
        for at in range(10, len(words), 20):
            far[at] = "changed"
        rows += [(i, " ".join(words)), (100 + i, " ".join(copy)), (200 + i, " ".join(far))]
        want |= {i, 200 + i}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_repeats_takes_passages_of_over_50_words(spark):
    r = random.Random(9)
    text = lambda n, most: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, most))) for _ in range(n))
    cut = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(51)), text(55, 7), text(51, 4), "x".join(text(60, 9).split())]
    left = [text(50, 6), text(20, 9)]
    assert all(len(p) < 400 for p in cut[:3])
    cut[3] = cut[3] * (1 + 400 // len(cut[3]))  # one long word
    rows, want = [], {}
    for k, passage in enumerate(cut + left):
        for i in range(3):
            parts = [f"{text(80, 8)} <{i}", f"{i}> {text(80, 8)}"]
            rows.append((10 * k + i, f"{parts[0]} {passage} {parts[1]}"))
            want[10 * k + i] = " ".join(parts[:1] + [passage] * (passage in left) + parts[1:])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text for x in corpus_pipeline.repeats(spark, docs, "").collect()}
    flat = lambda t: "".join(t.split())
    assert {i: flat(t) for i, t in got.items()} == {i: flat(t) for i, t in want.items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_without_labels_takes_only_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 0), (2, "12 34", None, "s", 0), (3, None, None, "s", 0), (4, "été", None, "s", 0)], SCHEMA)
    assert {x.doc_id for x in corpus_pipeline.language(spark, docs, "").collect()} == {1, 4}


def test_near_dedup_keeps_null_and_shared_ids(spark):
    docs = spark.createDataFrame([(None, "a text of no name", "en", "s", 0), (5, "one text", "en", "s", 0), (5, "quite another", "en", "s", 0), (5, "one text", "en", "t", 0)], SCHEMA)
    assert sorted(x.text for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == ["a text of no name", "one text", "quite another"]


def test_near_dedup_links_what_is_near_few_of_a_crowd(spark):
    """A short text is near one of a crowd alone, which isn't the central one, and shares its keys with all of the crowd."""
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(10):
        stem = words(200)
        central = stem + words(2)
        crowd = [stem, stem[:161], central, *[central + words(1) for _ in range(45)]]
        sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in crowd]
        assert [j for j in range(48) if j != 1 and 5 * len(sets[1] & sets[j]) >= 4 * len(sets[1] | sets[j])] == [0]
        rows += [(100 * i + j, " ".join(t), "en", "s", 0) for j, t in enumerate(crowd)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, rows, "").collect()) == [100 * i for i in range(10)]


def test_pairs_of_a_crowd_come_whole_from_its_parts(spark):
    r = np.random.default_rng(3)
    sketch = r.integers(0, 256, (1, similar.BANDS * similar.ROWS), np.uint8).repeat(90, 0)
    for row in sketch[:60]:
        row[r.choice(len(row), r.integers(0, 45), replace=False)] = r.integers(0, 256)
    n, root = r.integers(80, 120, 90).tolist(), r.integers(0, 9, 90).tolist()
    heads = spark.createDataFrame([(i, n[i], sketch[i].tobytes()) for i in range(90)], "content long, n long, sketch binary")
    rows = spark.createDataFrame([(5, i, root[i], 90) for i in range(90)], "key long, content long, root long, k long")
    close = lambda i, j: root[i] != root[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and (sketch[i] == sketch[j]).mean() >= similar.SKETCHED
    want = sorted((i, j) for i in range(90) for j in range(i + 1, 90) if close(i, j))
    for size in (10, 1000):
        assert sorted((min(x.a, x.b), max(x.a, x.b)) for x in similar.crowded_pairs(rows, heads, size).collect()) == want


def _crowd(r, n, words, least, most):
    """``n`` texts that each differ in ``least`` to ``most`` words from one stem."""
    stem = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        own = list(stem)
        for at in r.sample(range(words), r.randint(least, most)):
            own[at] = f"x{r.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def _alike(texts):
    sets = [set(similar.shingles(t).tolist()) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def test_links_of_a_crowd_connect_what_its_similar_pairs_connect(spark):
    """One part, several, one of a few contents; some roots are known, some texts are of other lengths."""
    r = random.Random(12)
    texts = _crowd(r, 70, 150, 1, 7) + [" ".join(t.split()[:130]) for t in _crowd(r, 10, 150, 0, 2)] + [" ".join(f"y{r.randrange(10**9)}" for _ in range(150)) for _ in range(5)]
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("sig", F.xxhash64("text"))
    own = similar._contents(docs).cache()
    number = {x.content: x.doc_id for x in own.collect()}
    node = {i: c for c, i in number.items()}
    assert len(number) == len(texts)
    pairs = _alike(texts)
    want = least_of(len(texts), pairs)
    assert 3 < len(set(want)) - 5 < 60 < len(pairs)
    known = pairs[:5]
    start = least_of(len(texts), known)
    rows = spark.createDataFrame([(5, node[i], node[start[i]], len(texts)) for i in range(len(texts))], "key long, content long, root long, k long")
    for size in (15, 1000):
        found = [(number[x.a], number[x.b]) for x in similar.crowded_links(rows, own, docs, size).collect()]
        assert {(min(p), max(p)) for p in found} <= set(pairs)
        assert least_of(len(texts), known + found) == want
        assert size < 1000 or len(found) == len(set(start)) - len(set(want))


def least_of(n, pairs):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root


def test_near_dedup_makes_no_rows_of_a_crowds_pairs(spark, monkeypatch):
    """Texts of one stem, none of which is near another, share their keys: rows in proportion to them, not to their pairs."""
    texts, write, rows = _crowd(random.Random(13), 400, 200, 3, 4), similar.stored, {}

    def counted(df, name):
        out = write(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(similar, "stored", counted)
    near = _alike(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert len(near) < 1000
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(least_of(len(texts), near))
    # a content's keys, the central ones of them and those drawn of them
    assert max(rows.values()) <= similar.BANDS * (1 + similar.DRAWN) * len(texts) < len(texts) * (len(texts) - 1) / 4, rows


def test_repeats_keeps_one_python_step_in_a_task(spark, monkeypatch):
    """Two in a row are two workers in a task, and idle ones stay for all later stages."""
    plans, write = [], substrings.stored
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def watched(df, name):
        plans.append(shown(df))
        return write(df, name)

    for module in (substrings, corpus_pipeline):
        monkeypatch.setattr(module, "stored", watched)
    docs = spark.createDataFrame([(i, f"{i} " * 60 + " ".join("abcdefghij" * 9), "en", "s", 0) for i in range(4)], SCHEMA)
    plans.append(shown(corpus_pipeline.repeats(spark, docs, "")))
    for plan in plans:
        for stage in re.split(r"\bExchange\b", plan):
            assert stage.count("MapInArrow") <= 1 + plan.count("Union")
    assert any("MapInArrow" in p for p in plans)
