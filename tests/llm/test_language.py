import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import language
from lectern.llm.language import document_probabilities, gradients, predict_language, start_weights, train, train_language

EN = "the people of this town have always said that there is nothing in the hills "
DE = "die Leute dieser Stadt haben schon immer gesagt dass in den Bergen nichts ist "


def test_gradient_equals_finite_differences():
    r = np.random.default_rng(1)
    weights = {k: v.astype(np.float64) for k, v in start_weights(3, units=3).items()}
    data, label = r.integers(0, 256, (5, 4)), np.array([0, 1, 2, 1])
    mask = np.ones((5, 4))
    mask[3:, 1] = 0
    _, grad = gradients(weights, data, mask, label)
    for k, v in weights.items():
        flat = v.reshape(-1)
        for i in np.argsort(-np.abs(grad[k].reshape(-1)))[:4]:
            keep, e = flat[i], 1e-2
            flat[i] = keep + e
            up, _ = gradients(weights, data, mask, label)
            flat[i] = keep - e
            down, _ = gradients(weights, data, mask, label)
            flat[i] = keep
            assert (up - down) / (2 * e) == pytest.approx(grad[k].reshape(-1)[i], rel=0.05, abs=2e-3)


def test_learns_two_languages():
    pairs = [("en", (EN * 9)[i : i + 64].encode()) for i in range(0, 400, 3)] + [("de", (DE * 9)[i : i + 64].encode()) for i in range(0, 400, 3)]
    languages, weights = train(pairs, epochs=12)
    p = document_probabilities(weights, [(EN * 5).encode(), (DE * 5).encode(), b""])
    assert [languages[i] for i in p[:2].argmax(axis=1)] == ["en", "de"]
    assert p[:2].sum(axis=1) == pytest.approx(1, abs=1e-3) and p[2].sum() == 0


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 2)
    rows = [(i, EN * 3 if i % 2 else DE * 3, "en" if i % 2 else "de", 1) for i in range(40)] + [(90, None, "en", 1), (91, "", None, 1), (92, "12 !", "de", 1), (93, EN, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in predict_language(docs, *train_language(docs)).collect()}
    assert len(got) == len(rows)
    assert {got[i].lang_pred for i in (90, 91, 92)} == {"und"} and got[93].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    none = docs.limit(0)
    assert predict_language(none, *train_language(none)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in predict_language(unlabelled, *train_language(unlabelled)).collect()} == {"und"}


@pytest.mark.parametrize("size", [1, 63, 64, 65, 5000])
def test_long_and_short_texts(size):
    p = document_probabilities(start_weights(2), [b"a" * size])
    assert p.sum() == pytest.approx(1, abs=1e-3)
