"""The corpus pipeline: language, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. SQL
can't express the stages, so there is no oracle; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import checkpointing, sized, stored
from lectern.llm.language import UNDETERMINED, predict_language, train_language
from lectern.llm.packing import pack_documents
from lectern.llm.pii import find_personal, sanitised
from lectern.llm.similar import similar_documents
from lectern.llm.substrings import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents of a lower score are in no language that the model knows.
LEAST_SCORE = 0.35
#: Repeated passages of more words than this go. They are found by strings of ``PASSAGE`` bytes, four a word. A passage of as many words in
#: fewer bytes can only lie in texts that hold so many short words in a row; those are searched by strings of ``SHORTEST`` bytes, one a
#: word and one between two.
WORDS = 50
PASSAGE, SHORTEST = 4 * WORDS, 2 * WORDS + 1
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; those without a letter or with an unsure prediction go.

    Where no document has a label there is no language to know, and only texts without a letter go.
    """
    if not docs.where("lang is not null").limit(1).count():
        return docs.where(F.rlike("text", F.lit(r"\p{L}"))).select(*COLUMNS)
    rows = predict_language(docs.select(*COLUMNS), *train_language(docs))
    return rows.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id in each group of near copies (five-word Jaccard similarity of 0.8 or more, chained).

    A null doc_id comes after all others. Of rows that share a doc_id, near copies are one and different texts stay.
    """
    checkpointing(spark)
    signed = docs.select(*COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("sig", F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = stored(similar_documents(signed), "groups")
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sig")).alias("head"))
    kept = kept.select(F.col("head.doc_id").alias("k_doc"), F.col("head.sig").alias("k_sig"))
    rows = signed.join(kept, F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("sig") == F.col("k_sig")), "left_semi")
    if groups.groupBy("doc_id", "sig").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "sig"])
    return rows.select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over ``WORDS`` words that occur again anywhere; a document of which nothing stays goes.

    So do repeated passages of 400 bytes or more in fewer words, as in texts without spaces.
    Bytes of a character that a cut has split are left out.
    """
    checkpointing(spark)
    rows = stored(without_repeats(docs.select(*COLUMNS).withColumn("cuts", F.lit(0)), PASSAGE, (WORDS + 1, PASSAGE)), "cut")
    dense = rows.where("dense")
    if not dense.isEmpty():
        rows = rows.where("not dense").drop("dense").unionByName(without_repeats(dense, SHORTEST))
    return rows.where((F.col("cuts") == 0) | F.rlike("text", F.lit(r"\S"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_repeats(docs: DataFrame, size: int, dense: tuple[int, int] | None = None) -> DataFrame:
    """``docs`` without the passages that strings of ``size`` bytes find; their number is added to cuts. With ``dense`` as ``remove_repeats`` takes it."""
    rows = remove_repeats(docs, size, size // 2, carry=("lang", "source", "cuts"), words=WORDS, dense=dense)
    text = F.try_validate_utf8(F.col("kept").cast("string"))
    broken = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")
    return rows.select("doc_id", F.coalesce(text, broken).alias("text"), "lang", "source", (F.col("cuts") + F.size("spans")).alias("cuts"), *(["dense"] if dense else []))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which personal data is replaced by its kind, and terms that disclose it are generalised or removed."""
    found = find_personal(docs).where("size(base) + size(secrets) + size(terms) > 0").select("doc_id", "sig", F.concat("base", "secrets").alias("base"), "terms").distinct()
    found = sized(stored(found, "personal").withColumnsRenamed({"doc_id": "p_doc", "sig": "p_sig"}), 100_000)
    filled = docs.select(*COLUMNS).withColumn("sig", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = filled.join(found, F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("sig") == F.col("p_sig")), "left")
    text = F.when(F.col("p_doc").isNull() & F.col("base").isNull(), F.col("text")).otherwise(sanitised(F.col("text"), F.col("base"), F.col("terms")))
    return rows.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("repeats", repeats),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages; what a stage returns is stored and read again for the next."""
    checkpointing(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
