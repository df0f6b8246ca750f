"""Messages matched against a bank of questions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.scalars import bound, contains_any, stripped, text_of

#: The assistant that the bank speaks of; its name is one of the signals that a question is about itself.
ASSISTANT = "lectern"
# Contractions, then phrases, rewritten in this order.
CONTRACTIONS = (
    ("what's", "what is"), ("who's", "who is"), ("where's", "where is"), ("when's", "when is"), ("why's", "why is"), ("how's", "how is"),
    ("it's", "it is"), ("that's", "that is"), ("there's", "there is"), ("here's", "here is"), ("i'm", "i am"), ("i've", "i have"),
    ("i'll", "i will"), ("i'd", "i would"), ("you're", "you are"), ("you've", "you have"), ("you'll", "you will"), ("we're", "we are"),
    ("we've", "we have"), ("we'll", "we will"), ("they're", "they are"), ("they've", "they have"), ("they'll", "they will"), ("can't", "can not"),
    ("cannot", "can not"), ("don't", "do not"), ("doesn't", "does not"), ("didn't", "did not"), ("won't", "will not"), ("wouldn't", "would not"),
    ("shouldn't", "should not"), ("couldn't", "could not"), ("hasn't", "has not"), ("haven't", "have not"), ("hadn't", "had not"), ("let's", "let us"),
)
PHRASES = (
    ("tell me about", "what is"), ("what can you tell me about", "what is"), ("give me info about", "what is"), ("give me information about", "what is"),
    ("who made you", "who created you"), ("who made", "who created"), ("who built you", "who created you"), ("what do you do", "what is your mission"),
    ("how do you work", "how does lectern find answers"), ("what can you do", "what can you help with"),
)
ALIASES = (
    ("tell me about", "tell me about lectern"), ("what can you tell me about", "tell me about lectern"), ("give me info about", "tell me about lectern"),
    ("give me information about", "tell me about lectern"), ("who made you", "who made you"), ("who made", "who made you"), ("who built you", "who made you"),
    ("what do you do", "what can you do"), ("how do you work", "how does Lectern find answers"), ("what can you do", "what can you do"),
    ("what are you", "what are you"), ("who are you", "who are you"), ("what's your mission", "what's your mission"), ("what's your purpose", "what's your purpose"),
    ("where are you from", "where are you from"),
)
SELF_SIGNALS = (
    "lectern", "you", "your", "yourself", "who made", "who created", "who built", "who owns", "who is behind", "what are you",
    "tell me about", "this ai", "this assistant", "this bot",
)
#: The bank, in the order in which it is searched: our own questions and answers.
BANK = (
    ("what is lectern", "An assistant for conversation logs and documents."),
    ("what are you", "An assistant for conversation logs and documents."),
    ("who are you", "An assistant for conversation logs and documents."),
    ("what can you do", "Answer questions about the documents, and keep their history."),
    ("who created lectern", "Its contributors."),
    ("who made you", "Its contributors."),
    ("tell me about lectern", "It reads documents, logs conversations and finds passages."),
    ("how does Lectern find answers", "It ranks passages by similarity to the question."),
    ("what's your mission", "To make documents easy to ask."),
    ("what's your purpose", "To make documents easy to ask."),
    ("where are you from", "From a cluster near you."),
    ("can you help young people", "Yes, with clear and simple answers."),
    ("do you store my messages", "Yes, in the conversation log."),
    ("Can Lectern draw pictures", "It can pass the request on."),
)
FUZZY = 0.82


def plain_contractions(text: str) -> str:
    """The rewriting on the driver, for the bank's own texts."""
    import re

    text = text.lower()
    for old, new in (*CONTRACTIONS, *PHRASES):
        text = re.sub(rf"\b{re.escape(old)}\b", new, text)
    return text


def plain_normal(text: str) -> str:
    import re

    return re.sub(r"[^a-z0-9 ]+", "", plain_contractions(text).strip().lower())


def expand_contractions(message: Column) -> Column:
    out = F.lower(text_of(message))
    for old, new in (*CONTRACTIONS, *PHRASES):
        out = F.regexp_replace(out, rf"\b{old}\b", new)
    return out


def faq_normal(message: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(expand_contractions(message))), "[^a-z0-9 ]+", "")


def faq_canonical(message: Column) -> Column:
    """The first alias that is in the message gives its question; else the message, normalised."""

    def first_alias(normal: Column) -> Column:
        out = F.when(normal == "", "")
        for alias, question in ALIASES:
            out = out.when(F.contains(normal, F.lit(plain_normal(alias))), question)
        return out.otherwise(normal)

    return bound(faq_normal(message), first_alias)


def is_self_query(message: Column) -> Column:
    return contains_any(F.lower(expand_contractions(message)), SELF_SIGNALS)


def bank(spark: SparkSession) -> DataFrame:
    """The bank as rows: ord, question, answer, normal. Its size is fixed, so it is sent to all tasks."""
    rows = [(i, q, a, plain_normal(q)) for i, (q, a) in enumerate(BANK)]
    return F.broadcast(spark.createDataFrame(rows, "ord int, question string, answer string, normal string"))


def asked(messages: DataFrame) -> DataFrame:
    """msg_id and asked, the canonical text, of the messages about the assistant."""
    return messages.where(is_self_query(F.col("text"))).select("msg_id", faq_canonical(F.col("text")).alias("asked")).where("asked <> ''")


def faq_substring(messages: DataFrame) -> DataFrame:
    """The first question of the bank that holds the message or is held by it."""
    q, a = F.col("question"), F.col("asked")
    hit = asked(messages).join(bank(messages.sparkSession), F.contains(a, q) | F.contains(q, a))
    return hit.groupBy("msg_id").agg(F.min(F.struct("ord", "question", "answer")).alias("m")).select("msg_id", "m.question", "m.answer")


def _tokens(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(value, " "), lambda t: F.length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens of more than two letters, as a share of all."""
    x, y = _tokens(a), _tokens(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def faq_jaccard(messages: DataFrame) -> DataFrame:
    """Token overlap of each message about the assistant with each question of the bank."""
    pairs = asked(messages).withColumn("asked", faq_normal(F.col("asked"))).join(bank(messages.sparkSession), F.lit(True))
    return pairs.select("msg_id", F.col("ord").cast("long").alias("ord"), F.round(jaccard(F.col("asked"), F.col("normal")), 6).alias("overlap"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _bonus(asked: Column, question: Column) -> Column:
    hit = F.lit(False)
    for alias, canonical in ALIASES:
        normal = plain_normal(alias)
        hit = hit | ((question == canonical) & (F.contains(asked, F.lit(normal)) | F.contains(F.lit(normal), asked)))
    return F.when(hit, 0.12).otherwise(0.0)


#: The characters of normal texts.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(text: Column) -> Column:
    """How often each of ``LETTERS`` is in a text."""
    return F.transform(F.array(*map(F.lit, LETTERS)), lambda x: F.length(text) - F.length(F.replace(text, x, F.lit(""))))


def ratio_bound(a: Column, b: Column, a_letters: Column, b_letters: Column) -> Column:
    """What the ratio of matching runs of two normal texts can be at most: runs that match have their letters in both."""
    both = F.aggregate(F.zip_with(a_letters, b_letters, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return 2 * both / (F.length(a) + F.length(b))


def faq_pairs(messages: DataFrame) -> DataFrame:
    """Each message about the assistant with each question of the bank: certain, the part of the score from tokens and aliases, and bound, what the whole can be at most."""
    rows = asked(messages).select("msg_id", faq_normal(F.col("asked")).alias("asked")).where("asked <> ''").withColumn("letters", letter_counts(F.col("asked")))
    own = F.broadcast(bank(messages.sparkSession).withColumn("own_letters", letter_counts(F.col("normal"))))
    pairs = rows.join(own, F.lit(True)).withColumn("certain", jaccard(F.col("asked"), F.col("normal")) * 0.3 + _bonus(F.col("asked"), F.col("question")))
    return pairs.withColumn("bound", ratio_bound(F.col("asked"), F.col("normal"), F.col("letters"), F.col("own_letters")) * 0.7 + F.col("certain"))


def faq_fuzzy(messages: DataFrame, least: float | None = None) -> DataFrame:
    """The score of each message about the assistant with each question: matching runs, token overlap, alias. With ``least`` only pairs that can reach it are scored."""
    pairs = faq_pairs(messages)
    if least is not None:
        pairs = pairs.where(F.col("bound") >= least - 1e-9)
    return pairs.select("msg_id", "ord", "question", "answer", (sequence_ratio("asked", "normal") * 0.7 + F.col("certain")).alias("score"))


def faq_best(messages: DataFrame, least: float = FUZZY) -> DataFrame:
    """The best question of each message, the earlier of equals, if its score is enough."""
    best = faq_fuzzy(messages, least).groupBy("msg_id").agg(F.max_by(F.struct("question", "answer", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.where(F.col("b.score") >= least).select("msg_id", "b.question", "b.answer", "b.score")


def faq_answer(messages: DataFrame, least: float = FUZZY) -> DataFrame:
    """The answer of the bank to each message about the assistant: the first question that holds it or is held by it, else the best by score.

    Joins with the bank are with its fixed rows (``BANK``), so pairs grow with the messages alone; only messages without the first are scored.
    """
    sure = faq_substring(messages).withColumn("by", F.lit("substring"))
    rest = messages.join(sure.select("msg_id"), "msg_id", "left_anti")
    return sure.unionByName(faq_best(rest, least).drop("score").withColumn("by", F.lit("fuzzy")))


def faq_candidates(messages: DataFrame, limit: int = 12) -> DataFrame:
    """The questions with the most points for a message: equal, prefix, shared tokens, alias."""
    from pyspark.sql import Window as W

    pairs = messages.select("msg_id", faq_canonical(F.col("text")).alias("asked")).where("asked <> ''").join(bank(messages.sparkSession), F.lit(True))
    a, q = F.col("asked"), F.col("normal")
    points = F.when(a == q, 100).otherwise(0) + F.when(F.startswith(q, a), 30).otherwise(0) + F.when(F.startswith(a, q), 20).otherwise(0)
    points = points + 6 * F.size(F.array_intersect(_tokens(a), _tokens(q)))
    for alias, canonical in ALIASES:
        normal = plain_normal(alias)
        points = points + F.when((F.col("question") == canonical) & (F.contains(a, F.lit(normal)) | F.contains(F.lit(normal), a)), 10).otherwise(0)
    rows = pairs.select("msg_id", "question", points.cast("int").alias("points")).where("points > 0")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("msg_id").orderBy(F.desc("points"), "question")))
    return ranked.where(F.col("rank") <= limit)
