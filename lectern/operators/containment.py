"""Texts matched with a large bank of phrases by containment, either way, without comparing all of them.

An inverted index of the bank's grams (``GRAM`` characters in a row, by hash) finds the candidates. A string's heads are its grams right behind a blank: about one for each word.

* A phrase that a text holds has all its grams there, and its heads among the text's heads. So the bank gives one row for each phrase, its rarest head (its rarest gram where it has no head,
  the whole of it where it is shorter than a gram), and texts look their heads up; all their grams, too, only where the bank has phrases without a head.
* A text that a phrase holds has all its grams among that phrase's. So a text with a head (a gram, where it has no head) that no phrase has is out, and each other one looks its rarest up
  among all of the bank's grams. Only texts no longer than the longest phrase are asked; they are written once. Those shorter than a gram are looked up whole, among the phrases' strings of their length.

Candidates are then held against the texts: where the bank is sent to all tasks, in the task that reads the text, otherwise behind equi-joins of hashes. So a long text is made once for each of
two passes, and no exploded row copies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import bound, text_of
from lectern.sources.scratch import scratch_path

GRAM = 6
#: Rows of the bank's side (two whole numbers each) that are sent to all tasks at most, and characters of its phrases; with more, both sides are dealt by gram.
SENT, SENT_CHARACTERS = 1_000_000, 32_000_000


def pieces(text: Column, size: int = GRAM) -> Column:
    """Array of a text's strings of ``size`` characters; empty for a shorter text."""
    # a look ahead takes no characters, so that the next match starts one further
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{size}}}))"), F.lit(1))


def head_pieces(text: Column) -> Column:
    """Array of a text's strings of ``GRAM`` characters right behind a blank."""
    return F.regexp_extract_all(text, F.lit(rf"(?s) (?=(.{{{GRAM}}}))"), F.lit(1))


def _hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda g: F.xxhash64(g)))


def grams(text: Column, size: int = GRAM) -> Column:
    """Array of the different hashes of a text's strings of ``size`` characters; empty for a shorter text."""
    return _hashes(pieces(text, size))


def keys(text: Column) -> Column:
    """The hashes of a text's heads; its grams, where it has no head."""
    return F.when(F.size(head_pieces(text)) > 0, _hashes(head_pieces(text))).otherwise(grams(text))


def sent(rows: DataFrame) -> DataFrame:
    """``rows`` marked for sending to all tasks if there are no more than ``SENT``, so that what is exploded needn't be shuffled to meet them."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def strings(text: Column, size: Column) -> Column:
    """Array of a text's different strings of ``size`` characters."""
    each = lambda cs: F.transform(F.sequence(F.lit(1), F.size(cs) - size + 1), lambda i: F.array_join(F.slice(cs, i, size), ""))
    return F.when(F.length(text) >= size, bound(F.split(text, ""), lambda cs: F.array_distinct(each(cs)))).otherwise(F.expr("cast(array() as array<string>)"))


def held_whole(short: DataFrame, long: DataFrame) -> DataFrame:
    """id of ``long`` and id of ``short`` (both id, text) where the text of under ``GRAM`` characters lies in the other one."""
    few = short.where(F.length("text").between(1, GRAM - 1)).select(F.col("id").alias("short_id"), F.col("text").alias("part"))
    sizes = few.agg(F.collect_set(F.length("part"))).scalar()  # GRAM - 1 values at most
    parts = long.select("id", "text", F.explode(sizes).alias("n")).select("id", F.explode(strings(F.col("text"), F.col("n"))).alias("part"))
    return parts.join(few, "part").select(F.col("id").alias("long_id"), "short_id")


def holding(texts: DataFrame, bank: DataFrame, counts: DataFrame) -> DataFrame:
    """text_id and phrase_id where the text holds the phrase."""
    phrases = bank.toDF("phrase_id", "phrase", "sig")
    own = bank.select("sig", "text").distinct().select("sig", F.explode(keys(F.col("text"))).alias("gram"))
    rarest = own.join(counts, "gram").groupBy("sig").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    rarest = rarest.unionByName(bank.where(F.length("text") < GRAM).select("sig", F.col("sig").alias("gram")).distinct())  # sig is such a phrase's hash as a whole

    headless = F.when(F.size(head_pieces(F.col("text"))) == 0, F.least(F.length("text"), F.lit(GRAM)))
    facts = bank.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.collect_set(headless).alias("sizes")).first()  # GRAM sizes at most
    found = F.array_distinct(F.concat(head_pieces(F.col("text")), *(pieces(F.col("text"), n) for n in sorted(facts.sizes))))
    # strings are hashed behind the explode: a lambda in it would take it out of generated code and copy the text for each of them
    looked = texts.select("id", "text", F.explode(found).alias("part")).select(F.col("id").alias("text_id"), "text", F.xxhash64("part").alias("gram"))
    if facts.n <= SENT and facts.characters <= SENT_CHARACTERS:
        pairs = looked.join(F.broadcast(rarest.join(phrases, "sig")), "gram")
    else:
        dealt = texts.select(F.col("id").alias("text_id"), "text", F.xxhash64("text").alias("text_sig"))
        few = dealt.select("text_sig", F.explode(_hashes(found)).alias("gram"))
        pairs = few.join(rarest, "gram").select("text_sig", "sig").distinct().join(phrases, "sig").join(dealt, "text_sig")
    return pairs.where(F.contains("text", "phrase")).select("text_id", "phrase_id")


def held(short: DataFrame, bank: DataFrame, listed: DataFrame, counts: DataFrame) -> DataFrame:
    """text_id and phrase_id where the phrase holds the text, of ``GRAM`` characters or more."""
    short = short.select("id", "text", F.xxhash64("text").alias("text_sig"))
    own = short.select("text_sig", "text").distinct().select("text_sig", F.explode(keys(F.col("text"))).alias("gram")).join(sent(counts), "gram", "left")
    known = own.groupBy("text_sig").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("unknown")).where("unknown = 0")
    pairs = known.select("text_sig", "gram").join(listed, "gram").select("text_sig", "sig")
    pairs = pairs.join(bank.toDF("phrase_id", "phrase", "sig"), "sig").join(short.withColumnRenamed("id", "text_id"), "text_sig")
    return pairs.where(F.contains("phrase", "text")).select("text_id", "phrase_id")


def containing(texts: DataFrame, bank: DataFrame) -> DataFrame:
    """text_id and phrase_id of every text and phrase (both id, text) of which one holds the other; pairs may come twice. Null and empty ones hold nothing and are in nothing.

    Ids may be null or repeated: inside, a text goes by its hash (sig).
    """
    texts, bank = (x.select("id", text_of(F.col("text")).alias("text")) for x in (texts, bank))
    bank = bank.where("text <> ''").withColumn("sig", F.xxhash64("text"))
    listed = bank.select("sig", "text").distinct().select("sig", F.explode(grams(F.col("text"))).alias("gram"))
    counts = listed.groupBy("gram").agg(F.count("*").alias("n"))

    longest = bank.agg(F.max(F.length("text"))).scalar()
    path = scratch_path(texts.sparkSession, "short")
    texts.where(F.length("text") <= longest).write.parquet(path)
    short = texts.sparkSession.read.schema(texts.schema).parquet(path).where("text <> ''")
    whole = held_whole(short, bank).toDF("phrase_id", "text_id").select("text_id", "phrase_id")
    return holding(texts, bank, counts).unionByName(held(short, bank, listed, counts)).unionByName(whole)


def first_phrase(texts: DataFrame, bank: DataFrame) -> DataFrame:
    """text_id and phrase_id: for each text that holds a phrase or lies in one, the least id of such a phrase."""
    return containing(texts, bank).groupBy("text_id").agg(F.min("phrase_id").alias("phrase_id"))
