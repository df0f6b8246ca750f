import difflib
import random

from pyspark.sql import functions as F

from lectern.operators import faq
from lectern.plans import registry

SF = "/root/testdata/sf0.01"


def some_messages(spark):
    r = random.Random(2)
    out = []
    for i in range(400):
        words = r.choice(faq.BANK)[0].lower().split()
        for _ in range(r.randrange(4)):
            k = r.randrange(len(words))
            words[k] = r.choice([words[k][::-1], words[k] + "s", "your", "data", words[k][:-1]])
        out.append((i, " ".join([*words, *r.choices(["you", "please", "now", ""], k=r.randrange(3))])))
    return spark.createDataFrame(out, "msg_id int, text string")


def test_bounds_hold_and_nothing_is_lost(spark):
    messages = some_messages(spark)
    every = {(r.msg_id, r.ord): r.score for r in faq.faq_fuzzy(messages).collect()}
    pairs = faq.faq_pairs(messages).collect()
    assert {(r.msg_id, r.ord) for r in pairs} == set(every) and len(every) > 1000
    for r in pairs:
        ratio = difflib.SequenceMatcher(None, r.asked, r.normal).ratio()
        assert abs(0.7 * ratio + r.certain - every[r.msg_id, r.ord]) < 1e-9 and every[r.msg_id, r.ord] <= r.bound + 1e-9
    for least in (0.68, faq.FUZZY):
        best = {}
        for (msg, at), score in sorted(every.items()):
            if score > best.get(msg, (0, None))[0]:
                best[msg] = score, at
        want = {m: faq.BANK[at][0] for m, (score, at) in best.items() if score >= least}
        assert {r.msg_id: r.question for r in faq.faq_best(messages, least).collect()} == want
    share = sum(r.bound >= faq.FUZZY - 1e-9 for r in pairs) / len(pairs)
    assert share < 0.4, f"{share:.3f} of the pairs are scored"


def test_pairs_are_filtered_before_python(spark):
    plan = faq.faq_best(some_messages(spark))._jdf.queryExecution().optimizedPlan().toString()
    python = plan.index("ArrowEvalPython")
    assert "bound" in plan[python:] or "0.82" in plan[python:] or "0.819999" in plan[python:]


def test_share_scored_in_conversations(spark):
    rows = registry.QUERIES["faq_bounds"](spark, SF)
    scored, all_ = rows.agg(F.count_if("scored"), F.count("*")).first()
    assert 0 < scored < all_ / 2
