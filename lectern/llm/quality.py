"""Quality rules: plain counts, then robust multivariate outliers for each language and source.

Each text gives a vector of transformed statistics, in whole thousandths, so that sums are exact and no result hangs on the order of rows.
A minimum-covariance-determinant estimate is made for each (lang, source) with ``LEAST`` passing texts; texts of smaller ones are
judged by their language's estimate, and by that of all texts where the language is small too. From several starts
(medians and deviations, the covariance of spatial signs, all texts) concentration steps repeat "the ``HALF`` with the least distances, its
mean and covariance" as grouped aggregates, so that no group is ever in one task. After ``TRIED`` steps the start of the least determinant
goes on until its determinant falls no more. A text is rejected if its Mahalanobis distance is beyond what a
normal vector reaches with probability ``TAIL``, and a margin.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointing, map_texts, sized, stored, texts_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_length", "f_word", "f_symbol", "f_lines", "f_repeat", "f_letters")
#: Concentration steps of every start, and of the best one at most.
TRIED, MOST = 2, 12
#: Share of a group's texts that an estimate rests on.
HALF = 0.75
#: Distances are ranked in steps of this part of their size.
FINE = 4096
#: Chance that a clean normal vector is rejected, and how much farther than that a text may lie: the statistics
#: have longer tails than a normal vector.
TAIL, MARGIN = 1e-6, 1.5
#: A group of fewer texts is judged by the next larger one: its language, then all texts.
LEAST = 50
#: Least standard deviation of a transformed statistic, so that a constant one doesn't reject what differs slightly.
FLOOR = (0.25, 0.1, 0.1, 0.3, 0.1, 0.03)
NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")
SPACE = " \t\n\x0b\x0c\r"


def repeated_words(words: list[str], size: int = 3) -> int:
    """Words in windows of ``size`` words that occur twice or more in the text, the first occurrence included."""
    if len(words) <= size:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    base = len(number) + 1
    if base < 1 << 21:
        key = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        pair = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)[1]
        key = pair * base + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def statistics(text: str) -> tuple[int, ...]:
    """The counts, and the number of letters.

    >>> statistics("a b\\na b\\n\\n# x")
    (6, 6, 1, 1, 0, 5)
    """
    flat = text.translate(_TO_BLANK) if not text.isascii() else text
    words = flat.encode("utf-8", "surrogatepass").split() if text.isascii() else [w for w in flat.split(" ") if w]
    chars = sum(map(len, words))
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    symbols = len(NOT_SYMBOL.sub("", text))
    letters = chars - symbols - sum(map(text.count, "0123456789"))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), letters


_TO_BLANK = dict.fromkeys(map(ord, SPACE), " ")


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and n_letters of every row; null texts are empty."""
    names = (*COUNTS, "n_letters")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names)))], ["doc_id", "lang", "source", *names])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return map_texts(docs, "text", "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names), work)


def features() -> list[Column]:
    """The transformed statistics, in thousandths: logarithms of sizes, square roots of shares."""
    words, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.col("n_dup_lines") + 1
    made = (F.log1p("n_words"), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.log(lines), F.sqrt(F.col("n_repeat_words") / words), F.greatest(F.col("n_letters"), F.lit(0)) / chars)
    return [F.round(c.cast("double") * 1000).cast("long").alias(n) for c, n in zip(made, FEATURES)]


def cutoff(tail: float = TAIL, size: int = len(FEATURES)) -> float:
    """The squared distance that a normal vector exceeds with probability ``tail`` (for an even number of statistics, a finite sum), by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        beyond = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(size // 2))
        low, high = (x, high) if beyond > tail else (low, x)
    return high


SHAPE = "grp string, start int, n long, mean array<double>, inverse array<double>, size double"
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _shapes(moments: DataFrame, products: str = "products", centre: str = "sums") -> DataFrame:
    """grp, start, n, mean, inverse covariance (flat) and size (logarithm of the covariance's determinant) of each row of moments.

    ``moments`` has grp, start, n, sums and products (exact sums of the statistics and their products, in thousandths), or ready
    covariances (cov, flat lower triangle) around ready means.
    """
    size, floor = len(FEATURES), np.diag(np.array(FLOOR) ** 2)
    at = tuple(np.array(x) for x in zip(*PAIRS))

    def run(frames):
        for f in frames:
            out = []
            for n, mean, given in zip(f["n"], f["mean"], f["given"]):
                full = np.zeros((size, size))
                full[at] = full[at[::-1]] = np.array(given, float)
                m = np.array(mean, float)
                cov = (full / n / 1e6 - np.outer(m / n / 1e3, m / n / 1e3) if products == "products" else full) + floor
                out.append((m / n / 1e3 if products == "products" else m, np.linalg.inv(cov).ravel(), np.linalg.slogdet(cov)[1]))
            yield pd.DataFrame({"grp": f["grp"], "start": f["start"], "n": f["n"], "mean": [o[0] for o in out], "inverse": [o[1] for o in out], "size": [o[2] for o in out]})

    return moments.select("grp", "start", "n", F.col(centre).alias("mean"), F.col(products).alias("given")).mapInPandas(run, SHAPE)


def _moments(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Count, sums and sums of products of the statistics, all whole numbers."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(f) for f in FEATURES]).alias("sums"), F.array(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in PAIRS]).alias("products"))


def _far(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """``rows`` (grp and the statistics) for each shape of their group, with start, n and the squared distance to it."""
    size = len(FEATURES)
    off = [F.col(f) / 1000 - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    joined = rows.join(sized(shapes.drop("size"), 20_000), "grp").select(*rows.columns, "start", "n", "inverse", *[o.alias(f"o{i}") for i, o in enumerate(off)])
    total = sum((F.col(f"o{i}") * F.col(f"o{j}") * F.col("inverse")[i * size + j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))
    return joined.select(*rows.columns, "start", "n", F.greatest(total, F.lit(0.0)).alias("distance"))


def _rank(distance: Column) -> Column:
    return F.floor(F.log(distance + 1e-9) * FINE).cast("int")


def _edges(ranked: DataFrame) -> DataFrame:
    """grp, start, edge: the least rank with ``HALF`` of the group's rows at or below it. From counts by rank; ``ranked`` has grp, start, rank."""
    place = W.partitionBy("grp", "start")
    counts = ranked.groupBy("grp", "start", "rank").agg(F.count("*").alias("k"))
    below = counts.withColumn("upto", F.sum("k").over(place.orderBy("rank"))).withColumn("all", F.sum("k").over(place))
    return below.where(F.col("upto") >= F.ceil(F.col("all") * HALF)).groupBy("grp", "start").agg(F.min("rank").alias("edge"))


def _step(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """The shapes of the rows that are nearest to the earlier shapes."""
    ranked = stored(_far(rows, shapes).select("grp", "start", *FEATURES, _rank(F.col("distance")).alias("rank")), "ranked")
    inner = ranked.join(sized(stored(_edges(ranked), "edges"), 20_000), ["grp", "start"]).where("rank <= edge")
    return stored(_shapes(_moments(inner, "grp", "start")), "shapes")


def _middles(counts: DataFrame) -> DataFrame:
    """grp, i, middle: the exact median from counts of values; ``counts`` has grp, i, v, k."""
    place = W.partitionBy("grp", "i")
    below = counts.withColumn("upto", F.sum("k").over(place.orderBy("v"))).withColumn("all", F.sum("k").over(place))
    return below.where(F.col("upto") * 2 >= F.col("all")).groupBy("grp", "i").agg(F.min("v").alias("middle"))


def _starts(rows: DataFrame) -> DataFrame:
    """The first shapes of each group, by three starts."""
    size = len(FEATURES)
    counts = stored(rows.select("grp", F.posexplode(F.array(*FEATURES)).alias("i", "v")).groupBy("grp", "i", "v").agg(F.count("*").alias("k")), "values")
    middle = _middles(counts)
    off = counts.join(middle, ["grp", "i"]).groupBy("grp", "i", F.abs(F.col("v") - F.col("middle")).alias("v")).agg(F.sum("k").alias("k"))
    both = middle.join(_middles(off).withColumnRenamed("middle", "spread"), ["grp", "i"])
    own = F.transform(F.array_sort(F.collect_list(F.struct("i", "middle", "spread"))), lambda x: F.struct(x["middle"].alias("m"), x["spread"].alias("d")))
    scale = [F.sqrt(F.pow(1.4826 * F.col("own")[i]["d"] / 1000, 2) + FLOOR[i] ** 2).alias(f"s{i}") for i in range(size)]
    middles = stored(both.groupBy("grp").agg(own.alias("own")).select("grp", F.transform("own", lambda x: x["m"] / 1000).alias("middle"), F.array(*scale).alias("scale")), "middles")

    near = rows.join(sized(middles, 20_000), "grp")
    z = [((F.col(f) / 1000 - F.col("middle")[i]) / F.col("scale")[i]).alias(f"z{i}") for i, f in enumerate(FEATURES)]
    signs = near.select("grp", *z).withColumn("norm", F.greatest(sum((F.col(f"z{i}") ** 2 for i in range(size)), F.lit(0.0)), F.lit(1e-9)))
    signs = signs.groupBy("grp").agg(F.count("*").alias("n"), *[F.sum(F.round(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm") * 1_000_000).cast("long")).alias(f"p{i}{j}") for i, j in PAIRS])
    ready = signs.join(middles, "grp")
    sign = ready.select("grp", F.lit(1).alias("start"), "n", "middle", F.array(*[F.col(f"p{i}{j}") / 1e6 / F.col("n") * size * F.col("scale")[i] * F.col("scale")[j] for i, j in PAIRS]).alias("cov"))
    plain = ready.select("grp", F.lit(0).alias("start"), "n", "middle", F.array(*[F.pow(F.col("scale")[i], 2) if i == j else F.lit(0.0) for i, j in PAIRS]).alias("cov"))
    whole = _shapes(_moments(rows, "grp").withColumn("start", F.lit(2)))
    return stored(_shapes(plain.unionByName(sign), "cov", "middle").unionByName(whole), "starts")


def robust_shapes(rows: DataFrame) -> DataFrame:
    """grp, start, n, mean, inverse, size: the minimum-covariance-determinant estimate for each group of ``rows`` (grp and the statistics)."""
    shapes = _starts(rows)
    for _ in range(TRIED):
        shapes = _step(rows, shapes)
    shapes = stored(shapes.groupBy("grp").agg(F.min_by(F.struct("start", "n", "mean", "inverse", "size"), F.struct("size", "start")).alias("s")).select("grp", "s.*"), "best")
    for _ in range(MOST - TRIED):
        after = _step(rows, shapes)
        better = shapes.join(after.select("grp", F.col("size").alias("next")), "grp").agg(F.max(F.col("size") - F.col("next"))).first()[0]
        shapes = after
        if better is None or better < 1e-6:
            break
    # the inner part varies less than the whole: the edge must lie where it would for a normal vector
    edges = _edges(_far(rows, shapes).select("grp", "start", _rank(F.col("distance")).alias("rank")))
    factor = F.least(F.lit(1.0), cutoff(1 - HALF) / F.exp((F.col("edge") + 1) / FINE))
    return stored(shapes.join(edges, ["grp", "start"]).withColumn("inverse", F.transform("inverse", lambda x: x * factor)).drop("edge"), "scaled")


def _level(level: int, *names: str) -> Column:
    """A group's name."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *names))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, distance (squared; null if base_failed) and kept of every row of ``docs`` (doc_id, text, lang, source).

    Null texts have no words and fail. Null languages and sources are groups like others; every text that passes the plain rules is
    judged, by the smallest of its groups that has ``LEAST`` such texts, or by all. Repeated rows come out repeated; other columns aren't
    read; an empty table gives no rows.
    """
    checkpointing(docs.sparkSession)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(with_statistics(docs).select("*", failed.alias("base_failed"), _level(2, "lang", "source").alias("pair"), *features()), "statistics")
    passing = rows.where("not base_failed")
    pairs = stored(passing.groupBy("pair", "lang", "source").agg(F.count("*").alias("n")), "pairs")
    langs = pairs.groupBy(_level(1, "lang").alias("one")).agg(F.sum("n").alias("lang_n"))
    named = pairs.withColumn("one", _level(1, "lang")).join(langs, "one")
    own = F.when(F.col("n") >= LEAST, F.col("pair")).when(F.col("lang_n") >= LEAST, F.col("one")).otherwise(_level(0))
    named = stored(named.select("pair", "one", own.alias("grp")), "named")
    members = named.select("pair", F.explode(F.array("pair", "one", _level(0))).alias("grp")).join(named.select("grp").distinct(), "grp", "left_semi")
    vectors = stored(passing.select("pair", *FEATURES).join(sized(stored(members, "members")), "pair").select("grp", *FEATURES), "vectors")
    shapes = robust_shapes(vectors)

    joined = rows.join(sized(named.select("pair", "grp")), "pair", "left").withColumn("grp", F.when(~F.col("base_failed"), F.col("grp")))
    far = _far(joined.where("grp is not null"), shapes)
    columns = ["doc_id", "lang", "source", *COUNTS, "base_failed"]
    judged = far.select(*columns, "distance", (F.col("distance") <= cutoff() * MARGIN**2).alias("kept"))
    return judged.unionByName(joined.where("grp is null").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents."""
    rows = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept", "distance")
