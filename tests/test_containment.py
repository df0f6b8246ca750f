import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import containment
from lectern.operators.containment import GRAM, containing, first_phrase, grams, head_pieces


def pairs(spark, texts, bank):
    rows = containing(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(bank, "id int, text string"))
    return {(r.text_id, r.phrase_id) for r in rows.collect()}


def plain(texts, bank):
    return {(i, j) for i, t in texts for j, p in bank if t and p and (t in p or p in t)}


@pytest.mark.parametrize("letters", ["ab", "abc ", "abcdefghij klmné😀"])
def test_containment_equals_all_pairs(spark, letters):
    r = random.Random(len(letters))
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    bank = [(j, word(r.choice([0, 1, 3, 5, 6, 7, 12, 30]))) for j in range(60)] + [(900, None)]
    texts = [(i, r.choice([word(r.choice([0, 1, 4, 6, 9, 40])), word(5) + (r.choice(bank[:-1])[1]) + word(3), r.choice(bank[:-1])[1][2:9]])) for i in range(80)] + [(901, None)]
    want = plain(texts, bank)
    assert pairs(spark, texts, bank) == want and want


def test_the_first_phrase(spark):
    texts = spark.createDataFrame([(1, "what is the answer to this"), (2, "answer"), (3, "none of it"), (4, "")], "id int, text string")
    bank = spark.createDataFrame([(7, "the answer to this"), (3, "is the answer"), (5, "unrelated words")], "id int, text string")
    assert sorted(map(tuple, first_phrase(texts, bank).collect())) == [(1, 3), (2, 3)]


def test_empty_sides(spark):
    assert pairs(spark, [(1, "some words")], [(2, None)]) == set() == pairs(spark, [(1, None)], [(2, "some words")])


def test_grams(spark):
    row = spark.createDataFrame([("abcdefgh" * 2, "abc")], "a string, b string").select(F.size(grams(F.col("a"))).alias("a"), F.size(grams(F.col("b"))).alias("b")).first()
    assert (row.a, row.b) == (8, 0) and GRAM == 6


def test_no_nested_loop_and_long_texts(spark):
    texts = spark.createDataFrame([(1, "x" * 10 + " words " * 40_000 + "the phrase itself"), (2, "short")], "id int, text string")
    bank = spark.createDataFrame([(j, f"the phrase number {j}") for j in range(500)] + [(999, "the phrase itself")], "id int, text string")
    rows = first_phrase(texts, bank)
    assert [tuple(r) for r in rows.collect()] == [(1, 999)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exploded_grams_meet_a_small_bank_without_a_shuffle(spark):
    texts, bank = (spark.createDataFrame([(1, "some words of text")], "id int, text string") for _ in range(2))
    plan = containing(texts, bank)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2
    assert [r.n for r in texts.select(F.size(grams(F.lit("a😀b\ncdé"))).alias("n")).collect()] == [2]


@pytest.mark.parametrize("letters", ["abc ", "a b😀"])
@pytest.mark.parametrize("sent", [10**6, 0])
def test_containment_by_heads_and_by_grams_equals_all_pairs(spark, monkeypatch, letters, sent):
    monkeypatch.setattr(containment, "SENT", sent)
    r = random.Random(sent + len(letters))
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    for sizes in ([12, 30, 60], [1, 3, 5, 6, 7, 30]):  # nearly all phrases with a head; some without
        bank = [(j, word(r.choice(sizes))) for j in range(50)] + [(800, "abc b abcabca"), (900, None), (901, "")]
        texts = [(i, r.choice([word(60), word(r.choice([0, 2, 6, 9])), word(4) + bank[j][1] + word(4), bank[j][1][3:14]])) for i in range(70) for j in [r.randrange(50)]]
        texts += [(800, "xabc b abcabcax"), (801, "xabc b abcabcx"), (802, " b abca"), (901, None), (902, "")]
        want = plain(texts, bank)
        assert pairs(spark, texts, bank) == want and {(800, 800), (802, 800)} <= want


def test_a_long_text_is_made_once_and_only_its_heads_are_looked_up(spark):
    texts = spark.createDataFrame([(1, "some words of text that hold a phrase or not")], "id int, text string").select("id", F.concat("text", F.lit(" marked")).alias("text"))
    bank = spark.createDataFrame([(1, "words of text that")], "id int, text string")
    found = containing(texts, bank)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" marked") == 1 and [tuple(r) for r in found.collect()] == [(1, 1)]
    assert texts.select(head_pieces(F.col("text")).alias("h")).first().h == ["words ", "of tex", "text t", "that h", "hold a", "a phra", "phrase", "or not", "not ma", "marked"]


@pytest.mark.parametrize("sent", [10**6, 0])
def test_repeated_and_missing_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(containment, "SENT", sent)
    bank = [(1, "the first phrase of all"), (1, "another phrase by that id"), (None, "a phrase without id"), (2, "the first phrase of all"), (3, "of"), (3, "id")]
    texts = [(7, "here is the first phrase of all of them"), (7, "and another phrase by that id too"), (None, "this is a phrase without id"), (8, "first phrase"), (8, "by that id"), (None, "phrase of all"), (None, "without id"), (9, "th"), (9, "ano")]
    assert pairs(spark, texts, bank) == plain(texts, bank)
