"""Exact document fingerprints; DataFrame functions only.

A text is made canonical (compatibility composition, full case folding, runs of white space to one blank) and digested
by two 64-bit xxhashes. Texts with the same digest are compared by their bytes: one text of a digest keeps it, any
other gets a number behind it. So equal fingerprints mean equal canonical texts, and the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointing, sized, stored

#: Documents that lie next to each other share a task if their doc_id agrees but for this many low bits.
NEIGHBOUR_BITS = 6
#: The same for the groups themselves, to bring them in order.
GROUP_BITS = 16


def canonical(text: Column) -> Column:
    """NFKC, case folding, white space folding and trimming; null is empty."""
    composed = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = lambda c: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    text = F.coalesce(text, F.lit(""))
    # for ASCII, lower case is all there is to do
    wide = composed(folded(composed(text)))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(wide)
    return F.trim(F.regexp_replace(plain, r"[\s\x1c-\x1f\p{IsWhite_Space}]+", " "))


def digest(canonical_text: Column) -> Column:
    """128 bits in 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canonical_text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), canonical_text)), 16, "0")))


def collisions(texts: DataFrame) -> DataFrame:
    """digest, canonical and rank (from 1) of the texts, other than the least, that share a digest with a different one.

    ``texts`` has digest and canonical. Only digests that occur more than once are looked at, and of them each different
    text once; so there is next to nothing here unless digests collide.
    """
    kinds = texts.groupBy("digest", "canonical").agg(F.count("*").alias("n"))
    several = kinds.groupBy("digest").agg(F.count("*").alias("kinds"), F.min("canonical").alias("least")).where("kinds > 1")
    others = kinds.join(several, "digest").where("canonical <> least").select("digest", "canonical").distinct()
    smaller = others.alias("a").join(others.withColumnsRenamed({"canonical": "c"}).alias("b"), "digest").where("c <= canonical")
    return smaller.groupBy("digest", "canonical").agg(F.count("*").alias("rank"))


def following(ids: DataFrame) -> DataFrame:
    """quotient and next: the least quotient above it; null for the last. ``ids`` has quotient.

    Ordered in two levels, so that one task sees a bounded stretch of quotients and one row for each stretch.
    """
    own = ids.select("quotient").distinct().withColumn("stretch", F.shiftright("quotient", GROUP_BITS))
    firsts = own.groupBy("stretch").agg(F.min("quotient").alias("first")).withColumn("after", F.lead("first").over(W.orderBy("stretch"))).select("stretch", "after")
    inner = own.withColumn("next", F.lead("quotient").over(W.partitionBy("stretch").orderBy("quotient")))
    return inner.join(firsts, "stretch").select("quotient", F.coalesce("next", "after").alias("next"))


def _ranks(made: DataFrame) -> DataFrame:
    """The ranks of texts whose digests collide; ``made`` has digest and text. Only texts of repeated digests are dealt out."""
    often = stored(made.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digests")
    shared = made.select("digest", "text").join(sized(often), "digest", "left_semi").select("digest", canonical(F.col("text")).alias("canonical"))
    return stored(collisions(shared), "collisions")


def _named(rows: DataFrame, ranks: DataFrame, digest_column: str, canonical_column: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint ``name``: the digest, and the rank if another text has the same."""
    if ranks.isEmpty():
        return rows.withColumn(name, F.col(digest_column))
    own = sized(ranks.withColumnsRenamed({"digest": "d__", "canonical": "c__", "rank": "r__"}))
    joined = rows.join(own, (F.col(digest_column) == F.col("d__")) & (F.col(canonical_column) == F.col("c__")), "left")
    return joined.withColumn(name, F.concat(digest_column, F.coalesce(F.concat(F.lit("-"), F.col("r__").cast("string")), F.lit("")))).drop("d__", "c__", "r__")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with fingerprint.

    Null texts are empty. Rows of equal canonical text, repeated rows too, have equal fingerprints. Other columns are
    kept, except an earlier one of that name; an empty table gives no rows.
    """
    checkpointing(docs.sparkSession)
    docs = docs.drop("fingerprint")
    made = docs.withColumn("canonical__", canonical(F.col("text"))).withColumn("digest__", digest(F.col("canonical__")))
    ranks = _ranks(made.select(F.col("digest__").alias("digest"), "text"))
    return _named(made, ranks, "digest__", "canonical__", "fingerprint").select(*docs.columns, "fingerprint")


def edited(text: Column, following_text: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as many code points of ``following_text``, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following_text, F.lit(1), half))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs`` (doc_id, text).

    The next document is that of the next larger doc_id (rows that share one follow each other by text); after the
    last comes the first. Likeness is 1 for equal canonical texts, 0 for others: the fingerprint is exact. Null texts
    are empty; an empty table gives no rows; other columns aren't read. A null doc_id comes before all others.

    Documents are dealt by the upper bits of doc_id, so that a task has the few neighbours of a stretch in order; the
    first document of each stretch is sent to the stretch before.
    """
    spark = docs.sparkSession
    checkpointing(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("quotient", F.shiftright("key", NEIGHBOUR_BITS))
    made = own.withColumn("digest", digest(canonical(F.col("text"))))

    ranks = _ranks(made)

    order = stored(following(own), "order")
    least = order.agg(F.min("quotient").alias("q")).first().q
    firsts = stored(own.groupBy("quotient").agg(F.min("key").alias("key")), "firsts")
    heads = own.join(sized(firsts), ["quotient", "key"]).groupBy("quotient").agg(F.min("text").alias("head"))
    heads = heads.withColumnRenamed("quotient", "next")
    tails = order.select("quotient", F.coalesce("next", F.lit(least).cast("long")).alias("next")).join(heads, "next").select("quotient", "head")

    place = W.partitionBy("quotient").orderBy("key", "text")
    placed = made.withColumn("follower", F.lead("text").over(place)).withColumn("follower_digest", F.lead("digest").over(place))
    rows = placed.join(tails, "quotient").withColumn("last", F.col("follower").isNull()).withColumn("follower", F.coalesce("follower", "head"))
    rows = rows.withColumn("follower_digest", F.when(F.col("last"), digest(canonical(F.col("follower")))).otherwise(F.col("follower_digest")))
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("follower")))
    rows = rows.withColumn("edit_canonical", canonical(F.col("edit"))).withColumn("edit_digest", digest(F.col("edit_canonical")))
    # bytes are compared where digests are equal
    own_canonical = canonical(F.col("text"))
    near_edit = F.when(F.col("digest") == F.col("edit_digest"), (own_canonical == F.col("edit_canonical")).cast("double")).otherwise(0.0)
    near_next = F.when(F.col("digest") == F.col("follower_digest"), (own_canonical == canonical(F.col("follower"))).cast("double")).otherwise(0.0)
    wanted = ["doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), "digest", "edit_digest", near_edit.alias("near_edited"), near_next.alias("near_next")]
    if not ranks.isEmpty():
        wanted += [own_canonical.alias("own_canonical"), "edit_canonical"]
    rows = _named(rows.select(*wanted), ranks, "digest", "own_canonical", "fingerprint")
    rows = _named(rows, ranks, "edit_digest", "edit_canonical", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
