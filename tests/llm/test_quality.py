import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from lectern.llm.quality import COUNTS, FINE, FLOOR, HALF, MOST, TRIED, cutoff, judge, op8_quality, repeated_words, statistics


def plain(text):
    blank = " \t\n\x0b\x0c\r"
    words = [w for w in "".join(" " if c in blank else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if any(c not in blank for c in line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("text", ["", " \n\t", "a", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "ü é\x85ö #*$ %&|<>", "one two three four one two three " * 5, "\x1f\x1c a"])
def test_counts(text):
    assert statistics(text)[:5] == plain(text)


def test_random_counts():
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["a", "b", "é", " ", "\n", "#", "  ", "\t"]) for _ in range(r.randint(0, 60)))
        assert statistics(text)[:5] == plain(text)


def test_many_different_words():
    words = [f"w{i}" for i in range(5000)] + ["w1", "w2", "w3"]
    assert repeated_words(words) == 6


def test_cutoff():
    assert cutoff(0.05) == pytest.approx(12.5916, abs=1e-3)


def features_of(text):
    n, chars, symbols, dup, again, letters = statistics(text)
    made = np.log1p(n), np.log(chars / n), np.sqrt(symbols / chars), np.log(dup + 1), np.sqrt(again / n), max(letters, 0) / chars
    return [float(np.floor(x * 1000 + 0.5)) for x in made]


def plain_distances(group, judged):
    """Squared distances of ``judged`` to the estimate over ``group``, by the same rule in plain numpy."""
    x, floor, m = group / 1000, np.diag(np.array(FLOOR) ** 2), len(group)
    low = lambda a: np.sort(a, axis=0)[(len(a) + 1) // 2 - 1]
    middle = low(group)
    scale = np.sqrt((1.4826 * low(np.abs(group - middle)) / 1000) ** 2 + np.array(FLOOR) ** 2)
    z = (x - middle / 1000) / scale
    z2 = np.maximum((z**2).sum(axis=1), 1e-9)
    sign = np.einsum("ni,nj->ij", z / z2[:, None], z) / m * 6 * np.outer(scale, scale)
    cov = lambda own: own.T @ own / len(own) - np.outer(own.mean(axis=0), own.mean(axis=0)) + floor
    far = lambda rows, shape: np.einsum("ni,ij,nj->n", rows - shape[0], np.linalg.inv(shape[1]), rows - shape[0])
    rank = lambda d: np.floor(np.log(d + 1e-9) * FINE)
    edge = lambda ranks: np.sort(ranks)[int(np.ceil(m * HALF)) - 1]

    def step(shape):
        ranks = rank(far(x, shape))
        own = x[ranks <= edge(ranks)]
        return own.mean(axis=0), cov(own)

    shapes = [(middle / 1000, np.diag(scale**2) + floor), (middle / 1000, sign + floor), (x.mean(axis=0), cov(x))]
    for _ in range(TRIED):
        shapes = [step(s) for s in shapes]
    size = lambda s: np.linalg.slogdet(s[1])[1]
    best = min(shapes, key=size)
    for _ in range(MOST - TRIED):
        best = step(best)
    factor = min(1.0, cutoff(1 - HALF) / np.exp((edge(rank(far(x, best))) + 1) / FINE))
    return far(judged / 1000, best) * factor


def test_outliers_go_and_clean_texts_stay(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(400):
        rows.append((i, " ".join(r.choice(vocabulary) for _ in range(r.randint(60, 900))), "en", f"s{i % 2}", 1))
    for i in range(400, 420):
        rows.append((i, " ".join(r.choice(vocabulary) + "%%%" for _ in range(200)), "en", f"s{i % 2}", 1))
    rows += [(600 + i, " ".join(r.choice(vocabulary) for _ in range(r.randint(60, 900))), "de", f"t{i}", 1) for i in range(60)]
    rows += [(500, None, "en", None, 1), (501, "", None, "s0", 1), (502, "w " * 40, None, None, 1), (503, "a b c " * 40, "en", "s0", 1), (504, rows[0][1], None, None, 1), (0, rows[0][1], "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    out = judge(docs).collect()
    assert len(out) == len(rows)
    by = {x.doc_id: x for x in out}
    for doc, text, *_ in rows:
        assert tuple(by[doc][c] for c in COUNTS) == plain(text or "")
    assert np.mean([by[i].kept for i in range(400)]) > 0.99
    assert not any(by[i].kept for i in range(400, 420))
    assert not any(by[i].kept for i in (500, 501, 502, 503)) and by[504].kept
    assert all(x.base_failed == (x.distance is None) for x in out)
    passing = [x for x in out if not x.base_failed]
    vector = lambda x: features_of(dict(rows_text)[x.doc_id])
    rows_text = [(x[0], x[1]) for x in rows]
    en = [x for x in passing if x.lang == "en" and x.source == "s0"]
    de = [x for x in passing if x.lang == "de"]
    for group, judged in ((en, en), (de, de), (passing, [by[504]])):
        want = plain_distances(np.array([vector(x) for x in group]), np.array([vector(x) for x in judged]))
        assert np.allclose([x.distance for x in judged], want, rtol=1e-6, atol=1e-9)
    assert judge(docs.limit(0)).count() == 0


def test_query(spark, small):
    docs = {x["doc_id"]: x["text"] for x in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    out = op8_quality(spark, small).collect()
    assert sorted(x.doc_id for x in out) == sorted(docs)
    for x in out:
        own = plain(docs[x.doc_id] or "") if len(docs[x.doc_id] or "") < 4000 else statistics(docs[x.doc_id])[:5]
        assert tuple(x[c] for c in COUNTS) == own
        assert x.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0]) and not (x.base_failed and x.kept)
