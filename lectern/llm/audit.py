"""Which filters of a chain remove what, in every order: a Walsh-Hadamard audit.

Each text fails some of ``FILTERS``; the set of them is its mask of five bits. Masks aren't counted cell by cell: for each part of the corpus and each label,
one pass sums 32 signed parities, S[w] = sum of (-1)^|mask & w|, in plain grouped sums. The transform is its own inverse up to the factor 32, so
the cells N[m] = (1/32) sum of (-1)^|m & w| S[w] come back exact, and all that the 120 orders ask is sums of cells:
what a step removes are the cells that fail its filter and none before it. A text that fails k filters is removed by each of them
in 120 / k of the orders, which is the Shapley share of a filter without going through the orders.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scalars import bound

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACE = r"[\x20\x09-\x0D]+"
#: What is counted apart, and which texts count for it.
LABELS = {"every": "true", "good": "good", "toxic": "toxic"}
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3


def text_mask(text: Column) -> Column:
    """The bits of A to D, which hang on the text alone: few words, repeated words, capitals, symbols."""

    def of_words(words: Column) -> Column:
        few = (F.size(words) < LEAST_WORDS).cast("int")
        return few + 2 * (100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words)).cast("int")

    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text).cast("long") - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    loud = (100 * capitals > MOST_CAPITALS * F.length(text).cast("long")).cast("int")
    return bound(words, of_words) + 4 * loud + 8 * F.rlike(text, F.lit(r"[#$%&*|]")).cast("int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: how many documents of a part fail these filters and have these labels.

    Equal texts are told by their SHA-256 digests. Only a text's least doc_id passes E, rows that share it included; null comes after all others. The rows of one text in a part are one by the
    first aggregate, inside the tasks that read them, so a text with very many copies is no single task's burden. More rows of ``labels`` on a
    document are one that holds if any does; their nulls hold nothing, and a null doc_id has no labels.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), text_mask(text).alias("mask"))
    held = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(held("quality").alias("good"), held("toxic").alias("toxic"))
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    nameless = rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    # a document is one row here, and rows that repeat a doc_id are counted
    keys = ["part", "key", "mask", "good", "toxic"]
    each = named.groupBy("doc_id", *keys).agg(F.count("*").alias("n")).unionByName(nameless.groupBy("doc_id", *keys).agg(F.count("*").alias("n")))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = each.groupBy(*keys).agg(F.sum("n").alias("n"), least.alias("least"))
    first = copies.groupBy("key").agg(F.min("least.doc_id").alias("first"))
    both = copies.join(first, "key")
    passing = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    two = F.array(F.struct("mask", passing.cast("long").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).cast("long").alias("n")))
    return both.select("part", "good", "toxic", F.explode(two).alias("c")).select("part", "c.mask", "good", "toxic", "c.n").where("n > 0")


def parity(a: Column, b: Column) -> Column:
    """1 where ``a`` and ``b`` share an even number of bits, else -1."""
    return 1 - 2 * F.bit_count(a.bitwiseAND(b)).bitwiseAND(F.lit(1))


def spectra(rows: DataFrame) -> DataFrame:
    """part and for each of ``LABELS`` the array of its 32 signed parity sums over ``rows`` (part, mask, good, toxic, n)."""
    def total(condition: str, w: int) -> Column:
        return F.sum(F.when(F.expr(condition), F.col("n") * parity(F.col("mask"), F.lit(w))).otherwise(F.lit(0))).cast("long")

    sums = [total(condition, w).alias(f"{name}_{w}") for name, condition in LABELS.items() for w in range(CELLS)]
    return rows.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{name}_{w}" for w in range(CELLS)]).alias(name) for name in LABELS])


def cells(spectrum: Column) -> Column:
    """The counts of the 32 masks that have this ``spectrum``."""
    w = F.sequence(F.lit(0), F.lit(CELLS - 1))
    at = lambda m: F.aggregate(F.zip_with(spectrum, w, lambda s, v: s * parity(m, v)), F.lit(0).cast("long"), lambda x, y: x + y)
    return F.transform(w, lambda m: F.shiftright(at(m), len(FILTERS)))


def over(counts: Column, holds, weight=lambda m: F.lit(1)) -> Column:
    """The sum of the cells whose mask ``holds``, each times its ``weight``."""
    w = F.sequence(F.lit(0), F.lit(CELLS - 1))
    picked = F.zip_with(counts, w, lambda n, m: F.when(holds(m), n * weight(m)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda x, y: x + y)


def orders(parts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from ``parts`` (part and the cells of each label)."""
    rows = parts.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda x: F.instr(F.col("filter_order"), x)
    bits = lambda holds: reduce(lambda x, y: x + y, [F.when(holds(place(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)])
    rows = rows.withColumns({"own": bits(lambda p: p == F.col("step")), "before": bits(lambda p: p < F.col("step"))})
    own, before = F.col("own"), F.col("before")
    none = lambda m, bits_: m.bitwiseAND(bits_) == 0
    gone = lambda m: ~none(m, own) & none(m, before)
    return rows.select(
        "part", "filter_order", "step",
        over(F.col("every"), lambda m: none(m, own) & none(m, before)).alias("kept"),
        over(F.col("every"), gone).alias("removed"),
        over(F.col("every"), lambda m: ~none(m, own) & ~none(m, before)).alias("redundant"),
        over(F.col("every"), lambda m: m == own).alias("unique_fails"),
        over(F.col("good"), gone).alias("good_lost"),
        over(F.col("toxic"), gone).alias("toxic_lost"),
        over(F.col("every"), lambda m: ~none(m, own), lambda m: F.expr(str(len(ORDERS))) / F.greatest(F.bit_count(m), F.lit(1))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for every part of ``docs``.

    ``docs`` has doc_id, text and lang, the part: null is the empty one. Null texts are empty. No documents give no rows; no labels give zeros; other columns aren't read.
    """
    parts = spectra(masks(docs, labels))
    return orders(parts.select("part", *[cells(F.col(name)).alias(name) for name in LABELS]))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents by their languages."""
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, (CASE WHEN len(ws) < 200 THEN ['A'] ELSE [] END)
   || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN ['B'] ELSE [] END)
   || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN ['C'] ELSE [] END)
   || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN ['D'] ELSE [] END)
   || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN ['E'] ELSE [] END) AS fails FROM d LEFT JOIN lab USING (doc_id)),
 g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT filter_order, CAST(i AS INT) AS step, substring(filter_order, i, 1) AS own, string_split(substring(filter_order, 1, i - 1), '') AS before FROM o, range(1, 6) r(i)),
 h AS (SELECT part, filter_order, step, n, good, toxic, len(fails) AS k, list_contains(fails, own) AS hit, list_has_any(fails, before) AS gone FROM g, s)
 SELECT part, filter_order, step, CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN hit AND k = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN hit THEN n * 120 // k ELSE 0 END) AS BIGINT) AS shapley FROM h GROUP BY part, filter_order, step"""
