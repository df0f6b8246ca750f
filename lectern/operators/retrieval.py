"""Vector search under filters, and what is made of its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.scalars import text_of


#: Bytes of queries that meet every vector in one pass; more queries are dealt to passes.
PASS = 64 << 20
#: Queries and vectors of a frame that are multiplied at a time: of these scores, and of some arrays as large, a task holds one set.
BLOCK, TILE = 256, 2048
#: Bytes of joined frames that Spark hands to a task at a time.
BATCH_BYTES = 8 << 20
#: Scores are told apart to so many digits.
DIGITS = 6


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return y @ x.T


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return _dot(x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True))


def _l2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[None] + (y * y).sum(axis=1)[:, None]
    squares -= 2 * _dot(x, y)
    np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)
    return np.subtract(0.0, squares, out=squares)


#: Scores of all vectors (rows of the first) for all queries (rows of the second).
SCORES = {"dot": _dot, "cosine": _cosine, "l2": _l2}


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _width(vectors: DataFrame) -> type:
    """Single precision is enough for vectors that are stored so."""
    return np.float32 if dict(vectors.dtypes)["vector"] == "array<float>" else np.float64


def _packed(rows: DataFrame, width: type) -> DataFrame:
    """ids and vectors (bytes) of ``rows`` (id, vector), many of them in a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, vectors = b.column("id").to_numpy(), _matrix(b.column("vector"), width)
                yield pa.RecordBatch.from_pydict({"ids": [ids.astype(np.int64).tobytes()], "vectors": [vectors.tobytes()]})

    return rows.where("id is not null and vector is not null").mapInArrow(work, "ids binary, vectors binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, id, score) of the ``k`` best columns of each row of ``scores``, the lesser id of equals."""
    place = np.argsort(ids, kind="stable").argsort(kind="stable")
    scores = np.floor(scores * 10**DIGITS + 0.5)
    last = 2.0**62 / len(ids)  # what is beyond comes first or last, as what isn't a number comes last
    ranked = np.nan_to_num(scores, nan=-last, posinf=last, neginf=-last)
    np.clip(ranked, -last, last, out=ranked)
    key = np.negative(ranked, out=ranked).astype(np.int64)
    key *= len(ids)
    key += place
    k = min(k, len(ids))
    at = np.argpartition(key, k - 1, axis=1)[:, :k] if k < len(ids) else np.broadcast_to(np.arange(k), (len(scores), k))
    return np.repeat(np.arange(len(scores)), k), ids[at].ravel(), np.take_along_axis(scores, at, axis=1).ravel() / 10**DIGITS


def _best_by_tiles(score: Callable, x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best`` of all vectors ``x`` for the queries ``y``, of which only ``TILE`` are scored at a time: the best of the tiles' best."""
    if len(ids) <= TILE:
        return _best(ids, score(x, y), k)
    found = [_best(ids[a : a + TILE], score(x[a : a + TILE], y), k) for a in range(0, len(ids), TILE)]
    vec, value = (np.concatenate([f[i].reshape(len(y), -1) for f in found], axis=1) for i in (1, 2))
    k = min(k, vec.shape[1])
    at = np.lexsort((vec, np.where(np.isnan(value), np.inf, -value)), axis=1)[:, :k]
    return np.repeat(np.arange(len(y)), k), np.take_along_axis(vec, at, axis=1).ravel(), np.take_along_axis(value, at, axis=1).ravel()


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "dot") -> DataFrame:
    """query_id, vec_id, score, rank: the ``k`` best vectors of each query, the lesser vec_id of equals.

    An exhaustive scan, as exact results need. Vectors and queries are packed, frames of each to a row, and each frame of vectors is multiplied with all queries, which go to all tasks
    in passes of ``PASS`` bytes at most, in blocks and tiles of bounded size; it keeps the ``k`` best of each query by partial selection. So vectors are read once a pass, and what is shuffled is k rows a query and frame, not a row a pair.
    """
    score = SCORES[metric]
    # in force when the result is run; Spark's own bound is 64 MB, and each of an executor's tasks holds a batch on both sides
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    asked = queries.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    width, own_width = _width(rows), _width(asked)
    size = asked.agg(F.sum(np.dtype(own_width).itemsize * F.size("vector") + 8)).first()[0] or 0
    passes = -(-size // PASS) or 1
    frames = _packed(rows, width).toDF("ids", "vectors")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, own = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("ids", "q_ids"))
                x, y = (np.frombuffer(b.column(c)[i].as_py(), w).astype(np.float64).reshape(len(n), -1) for c, n, w in (("vectors", ids, width), ("q_vectors", own, own_width)))
                for a in range(0, len(own), BLOCK):
                    row, vec, value = _best_by_tiles(score, x, y[a : a + BLOCK], ids, k)
                    yield pa.RecordBatch.from_pydict({"query_id": own[a : a + BLOCK][row], "vec_id": vec, "score": value})

    def best(part: DataFrame) -> DataFrame:
        return frames.join(F.broadcast(_packed(part, own_width).toDF("q_ids", "q_vectors")), F.lit(True)).mapInArrow(work, "query_id long, vec_id long, score double")

    parts = [asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i) for i in range(passes)] if passes > 1 else [asked]
    found = reduce(DataFrame.unionByName, [best(p) for p in parts])
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def strict_filter(role: str, grade: int | None = None) -> Column:
    """Audience must be named; a student's grade must lie within bounds that are there."""
    audience = F.col("audience").isin(role, "both")
    return audience if role == "teacher" else audience & (F.col("grade_min") <= F.lit(grade)) & (F.col("grade_max") >= F.lit(grade))


def lenient_filter(role: str, grade: int | None = None) -> Column:
    """No audience is both; bounds that aren't there let every grade pass; no grade, or 0, is 10."""
    audience = F.coalesce("audience", F.lit("both")).isin(role, "both")
    if role == "teacher":
        return audience
    grade = grade or 10
    return audience & (F.coalesce("grade_min", F.lit(grade)) <= grade) & (F.coalesce("grade_max", F.lit(grade)) >= grade)


def shaped(rows: DataFrame) -> DataFrame:
    """Results for display: a text's first 200 characters, the name of its file."""
    text = text_of(F.col("text"))
    cut = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)
    return rows.select("id", cut.alias("text"), F.element_at(F.split("source_file", "/"), -1).alias("source"))


def contexts(results: DataFrame, texts: DataFrame) -> DataFrame:
    """For each query its results' texts, best first."""
    joined = results.join(texts, "vec_id")
    own = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return joined.groupBy("query_id").agg(F.array_join(own, "\n\n").alias("context"))


def augmented(message: Column, facts: Column, reply: Column, document: Column) -> Column:
    """A message with what is known: facts innermost, then what it replies to, then the document."""
    out = F.when(text_of(facts) != "", F.concat(F.lit("Known facts for this user (use when relevant): "), facts, F.lit("\n\n"), message)).otherwise(message)
    out = F.when(text_of(reply) != "", F.concat(F.lit('The user is replying to your previous message: "'), reply, F.lit('"\n\nTheir follow-up: '), out)).otherwise(out)
    return F.when(text_of(document) != "", F.concat(F.lit("Use the following document the user uploaded in this session when relevant:\n"), document, F.lit("\n\nUser question: "), out)).otherwise(out)
