import random
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest

from lectern.llm import toxicity
from lectern.llm.toxicity import Machine, held_out, op9_toxicity, score_toxicity, term_buckets, train, train_toxicity


def test_machine_equals_the_plain_formula():
    r = np.random.default_rng(1)
    m = Machine(0.3, r.normal(size=toxicity.BUCKETS).astype(np.float32), r.normal(size=(toxicity.BUCKETS, 3)).astype(np.float32))
    texts = ["one two three", "", "two two four"]
    for text, got in zip(texts, m.score(texts)):
        b = term_buckets(text)
        z = m.bias + sum(m.weight[i] for i in b) + sum(m.vector[i] @ m.vector[j] for k, i in enumerate(b) for j in b[:k])
        assert got == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def _samples():
    """Toxic only where an insult meets a group: no additive weights can tell."""
    r, out = random.Random(2), []
    for i in range(1600):
        insult, group = i % 2, i // 2 % 2
        words = [f"w{r.randint(0, 30)}" for _ in range(6)] + ["fool"] * insult + ["them"] * group
        out.append((insult & group, " ".join(words)))
    return out


def test_learns_an_interaction():
    rows = _samples()
    m = train([(y, term_buckets(t)) for y, t in rows], prior=0.25)
    right = (m.score([t for _, t in rows]) >= 0.5) == [bool(y) for y, _ in rows]
    assert right.mean() > 0.97


def test_documents(spark):
    rows = _samples()
    docs = [(i, t, 5) for i, (_, t) in enumerate(rows)] + [(9000, None, 5), (9001, "", 5), (9002, " ", 5), (9000, None, 5)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, 1, y) for i, (y, _) in enumerate(rows)] + [(9000, None, None)], "doc_id long, quality int, toxic int")
    machine = train_toxicity(docs, labels)
    out = score_toxicity(docs, machine).withColumn("out", held_out()).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    right = [r.predicted == rows[r.doc_id][0] for r in out if r.doc_id < 9000 and r.out]
    assert len(right) > 200 and sum(right) > 0.97 * len(right)
    assert train_toxicity(docs, labels.limit(0)) is None
    assert {r.score for r in score_toxicity(docs, None).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), machine).count() == 0


def test_an_interaction_of_terms_that_say_nothing_alone():
    r = random.Random(8)
    filler = [f"w{i}" for i in range(400)]

    def text(label):
        a, b = r.choice([("alpha", "group"), ("omega", "other")] if label else [("alpha", "other"), ("omega", "group")])
        return " ".join(r.sample(filler, 20) + [a, b])

    machine = train([(y, term_buckets(text(y))) for y in [0, 1] * 600], 0.5)
    for y in (0, 1):
        assert np.mean((machine.score([text(y) for _ in range(200)]) >= 0.5) == y) > 0.95


def test_query(spark, small):
    docs = {x["doc_id"] for x in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    out = op9_toxicity(spark, small).collect()
    assert {x.doc_id for x in out} == docs and len(out) == len(docs)
    for x in out:
        assert x.held_out == (crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.5) and 0 <= x.score <= 1
