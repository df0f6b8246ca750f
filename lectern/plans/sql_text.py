"""Queries in SQL text alone, over the library's SQL functions; each gives what a DataFrame query gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import lines as N
from lectern.plans import chat, files, text
from lectern.session import spread, table
from lectern.sources.fixtures import view
from lectern.sources.sql_functions import registered


def _sql(statement: str, **tables) -> callable:
    """The statement over named tables, each a function of (spark, sf_dir)."""
    return lambda s, d: registered(s).sql(statement, **{name: of(s, d) for name, of in tables.items()})


def _messages(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "messages")


def _documents(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents"))


def _kinds(s: SparkSession, d: str) -> DataFrame:
    """Lines of documents, made flat, with their kinds."""
    lines = N.doc_lines(_documents(s, d)).select("doc_id", "line_no", N.collapsed(F.col("line")).alias("flat"))
    return lines.withColumn("kind", N.kind_of(F.col("flat")))


QUERIES = {
    "sql_snippet": _sql("SELECT msg_id, snippet(text) AS snippet FROM {messages}", messages=_messages),
    "sql_role_instruction": _sql("SELECT msg_id, role_instruction(access_role(user_email)) AS instruction FROM {messages}", messages=_messages),
    "sql_sentence_counts": _sql("SELECT doc_id, CAST(size(sentences_of(text)) AS BIGINT) AS sentences FROM {documents}", documents=_documents),
    "sql_list_lines": _sql("SELECT doc_id, CAST(pos AS INT) AS line_no FROM {documents}, LATERAL posexplode(split(coalesce(text, ''), '\\n')) AS l(pos, line) WHERE is_list_item(line)", documents=_documents),
    "sql_packed_chunks": _sql(
        "SELECT key AS doc_id, chunk_index, text, sentence_count FROM packed_chunks(TABLE(SELECT doc_id AS key, pos AS at, part FROM (SELECT doc_id, sentences_of(coalesce(text, '')) AS parts FROM {documents}), LATERAL posexplode(parts) AS s(pos, part)) PARTITION BY key ORDER BY at)",
        documents=_documents,
    ),
    "sql_line_blocks": _sql(
        "SELECT key AS doc_id, block, element_type, lines, text FROM line_blocks(TABLE(SELECT doc_id AS key, line_no AS at, flat, kind FROM {kinds}) PARTITION BY key ORDER BY at)",
        kinds=_kinds,
    ),
}

ORACLES = {
    "sql_snippet": chat.ORACLES["snippet"],
    "sql_role_instruction": files.ORACLES["role_instruction"],
    "sql_sentence_counts": text.ORACLES["sentence_counts"],
    "sql_list_lines": text.ORACLES["list_lines"],
    "sql_packed_chunks": text.ORACLES["chunk_paragraphs"],
    "sql_line_blocks": text.ORACLES["line_blocks"],
}
