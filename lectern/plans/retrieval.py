"""Queries on vectors, filters and what is made of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import retrieval as V
from lectern.session import table


def _vectors(s, d):
    """Vectors with audiences and grades by their number; one in eleven names no audience, one in five has no grades."""
    audience = F.when(F.col("vec_id") % 11 == 0, None).when(F.col("vec_id") % 3 == 0, "teacher").when(F.col("vec_id") % 3 == 1, "student").otherwise("both")
    graded = lambda c: F.when(F.col("vec_id") % 5 != 0, c).cast("int")
    return table(s, d, "embeddings").withColumn("audience", audience).withColumn("grade_min", graded(F.col("vec_id") % 12)).withColumn("grade_max", graded(F.col("vec_id") % 12 + 3))


def _asked(s, d):
    return table(s, d, "embeddings").where("vec_id % 50 = 0")


def _near(metric, k=6):
    return lambda s, d: V.nearest(table(s, d, "embeddings"), _asked(s, d), k, metric)


def _filtered(condition, k=3):
    return lambda s, d: V.nearest(_vectors(s, d).where(condition()), _asked(s, d), k)


def _whole_texts(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")


def _augmented(s, d):
    docs, n = table(s, d, "documents"), F.col("doc_id")
    return docs.select("doc_id", V.augmented(F.col("text"), F.when(n % 2 == 0, F.lit("A = b")), F.when(n % 3 == 0, F.lit("earlier")), F.when(n % 5 == 0, F.col("source"))).alias("prompt"))


QUERIES = {
    "knn_dot": _near("dot"),
    "knn_cosine": _near("cosine"),
    "knn_l2": _near("l2"),
    "filter_strict": lambda s, d: _vectors(s, d).where(V.strict_filter("student", 7)).select("vec_id"),
    "filter_strict_teacher": lambda s, d: _vectors(s, d).where(V.strict_filter("teacher")).select("vec_id"),
    "filter_lenient": lambda s, d: _vectors(s, d).where(V.lenient_filter("student", 0)).select("vec_id"),
    "filter_lenient_teacher": lambda s, d: _vectors(s, d).where(V.lenient_filter("teacher")).select("vec_id"),
    "knn_filtered": _filtered(lambda: V.lenient_filter("student", 7)),
    "knn_filtered_teacher": _filtered(lambda: V.lenient_filter("teacher")),
    "result_shape": lambda s, d: V.shaped(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"))),
    "rag_context": lambda s, d: V.contexts(V.nearest(table(s, d, "embeddings"), _asked(s, d), 6), _whole_texts(s, d)),
    "augment_prompt": _augmented,
    "rag_context_all": lambda s, d: V.contexts(V.nearest(table(s, d, "embeddings"), _asked(s, d), 6), _whole_texts(s, d)),
    "augment_prompt_all": _augmented,
}

VECTORS = """WITH v AS (SELECT *, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 'teacher' WHEN vec_id % 3 = 1 THEN 'student' ELSE 'both' END AS audience,
 CASE WHEN vec_id % 5 <> 0 THEN vec_id % 12 END AS grade_min, CASE WHEN vec_id % 5 <> 0 THEN vec_id % 12 + 3 END AS grade_max FROM embeddings)"""
A, B = "CAST(e.embedding AS DOUBLE[])", "CAST(q.embedding AS DOUBLE[])"
DOT, L2 = f"list_inner_product({A}, {B})", f"0.0 - sqrt(list_sum(list_transform(list_zip({A}, {B}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
COSINE = f"{DOT} / (sqrt(list_inner_product({A}, {A})) * sqrt(list_inner_product({B}, {B})))"


def _knn(score: str, k: int, source: str = "embeddings", where: str = "TRUE") -> str:
    return f"SELECT q.vec_id AS query_id, e.vec_id, round({score}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({score}, 6) DESC, e.vec_id) AS INT) AS rank FROM (SELECT * FROM {source} WHERE {where}) e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY rank <= {k}"


STUDENT = "coalesce(audience, 'both') IN ('student', 'both') AND coalesce(grade_min, {0}) <= {0} AND coalesce(grade_max, {0}) >= {0}"
TEACHER = "coalesce(audience, 'both') IN ('teacher', 'both')"

ORACLES = {
    "knn_dot": _knn(DOT, 6),
    "knn_cosine": _knn(COSINE, 6),
    "knn_l2": _knn(L2, 6),
    "filter_strict": f"{VECTORS} SELECT vec_id FROM v WHERE audience IN ('student', 'both') AND grade_min <= 7 AND grade_max >= 7",
    "filter_strict_teacher": f"{VECTORS} SELECT vec_id FROM v WHERE audience IN ('teacher', 'both')",
    "filter_lenient": f"{VECTORS} SELECT vec_id FROM v WHERE {STUDENT.format(10)}",
    "filter_lenient_teacher": f"{VECTORS} SELECT vec_id FROM v WHERE {TEACHER}",
    "knn_filtered": f"{VECTORS} {_knn(DOT, 3, 'v', STUDENT.format(7))}",
    "knn_filtered_teacher": f"{VECTORS} {_knn(DOT, 3, 'v', TEACHER)}",
    "result_shape": "SELECT doc_id AS id, CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS text, concat(doc_id, '.txt') AS source FROM documents",
    "rag_context": f"WITH r AS ({_knn(DOT, 6)}) SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents d ON d.doc_id = r.vec_id GROUP BY query_id",
    "augment_prompt": """SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN concat('Use the following document the user uploaded in this session when relevant:', chr(10), source, chr(10), chr(10), 'User question: ') END,
 CASE WHEN doc_id % 3 = 0 THEN concat('The user is replying to your previous message: "earlier"', chr(10), chr(10), 'Their follow-up: ') END,
 CASE WHEN doc_id % 2 = 0 THEN concat('Known facts for this user (use when relevant): A = b', chr(10), chr(10)) END, text) AS prompt FROM documents""",
}
#: Earlier names of the same.
ORACLES["rag_context_all"], ORACLES["augment_prompt_all"] = ORACLES["rag_context"], ORACLES["augment_prompt"]
