"""Views that bring the tables into the shapes of a chat service: one SQL text for Spark and DuckDB.

``{at(x)}`` in a text is the time of second x, which the two write differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lectern.session import table

START = "2024-01-01 00:00:00"

CHAT_LOGS = """
SELECT concat('log-', conv_id, '-', turn) AS log_id, CAST(conv_id AS STRING) AS session_id,
       concat('user', conv_id % 3, CASE WHEN conv_id % 3 = 0 THEN '@education.example' ELSE '@students.example' END) AS user_email,
       concat('User ', conv_id % 3) AS user_name, text AS user_prompt, CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS response,
       CASE WHEN turn % 6 = 2 THEN concat('/files/', conv_id, '.pdf') END AS pdf_url,
       CASE WHEN turn % 4 = 2 THEN concat('image ', conv_id, '~', turn, '*.png') END AS image_filename,
       CASE WHEN turn % 4 IN (2, 3) THEN 'image/png' END AS image_mime_type,
       CASE WHEN turn % 4 = 3 THEN 'aGVsbG8=' END AS image_base64,
       {at(conv_id * 1000 + turn)} AS timestamp_utc, CAST((conv_id * 7 + turn) % 6 AS INT) AS stars, conv_id * 1000 + turn AS seq
FROM (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations)
WHERE role = 'user'
"""

LOG_EVENTS = """
SELECT log_id, session_id, user_email, user_prompt, '' AS response, image_filename, 2 * seq AS op_seq FROM chat_logs
UNION ALL SELECT log_id, session_id, user_email, user_prompt, response, CAST(NULL AS STRING), 2 * seq + 1 FROM chat_logs
"""

SHARED_CHATS = """
SELECT concat('token-', conv_id) AS share_token, CAST(conv_id AS STRING) AS session_id,
       CASE WHEN conv_id % 15 = 0 THEN NULL WHEN conv_id % 15 = 5 THEN {at(3600)} ELSE {at(31536000)} END AS expires_at_utc, conv_id % 20 <> 0 AS is_active
FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 = 0
"""

MESSAGES = """
SELECT CAST(seq AS BIGINT) AS msg_id, session_id, seq AS ord, user_email, user_prompt AS text FROM chat_logs
UNION ALL SELECT CAST(-ord AS BIGINT), concat('m', ord % 7), ord, concat('user', ord % 3, CASE WHEN ord % 3 = 0 THEN '@education.example' ELSE '@students.example' END), text
FROM (VALUES {rows}) AS m(ord, text)
"""

#: Messages that reach every branch of the routing rules; the tables' invented prose reaches few.
ENGLISH = (
    "make a poster of coral", "What is 3 + 4 * 2?", "solve x^2 = 9", "Please RESOLVE this", "evaluate the limit", "5 apples", "a √ and ∑ too", "Explain step by step why is the sky blue", "compare cats and dogs",
    "search for volcanoes", "Google the latest news", "wikipedia photosynthesis", "wiki for reefs", "look up coral", "find for", "draw a picture of a tree", "make me a rose",
    "design a logo", "create a poster that says \"Hello World\"", "a banner with no text please", "certificate titled Best Pupil", "portrait of a cat", "visualize sound", "photo", "all but 9 sheep die, how many are left",
    "all but 12 went home", "All but 3 REMAIN", "create a lesson plan on Fractions for grade 7, 35 minutes", "lesson plan about The Water Cycle And Weather for grade 10, 1 hour, prerequisite: evaporation", "make a lesson in Science for grade 8", "teaching plan please", "short notes on cells", "summarize this chapter",
    "export as PDF", "show a diagram", "DOE stands for Department of Education", "what is x", "gravity is called the weak force", "HTML means HyperText Markup Language.", "It is known as a longer term indeed", "WHO is the World Health Organization",
    "who are you?", "What's your mission", "tell me about this assistant", "what can you do for young people", "who made this", "hello", "  padded   text  ", "how do you work?",
    "can't you help", "don't they know", "where are you from", "you", "thanks", "été français", "100% sure_thing", "it's what it's", "give me info about rivers", "what do you do",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(text: str, spark: bool) -> str:
    at = (lambda x: f"(TIMESTAMP_NTZ '{START}' + make_dt_interval(0, 0, 0, {x}))") if spark else (lambda x: f"(TIMESTAMP '{START}' + to_seconds({x}))")
    text = re.sub(r"\{at\(([^{}]*)\)\}", lambda m: at(m[1]), text)
    return text.replace("{rows}", ", ".join(f"({i + 1}, {_quoted(t)})" for i, t in enumerate(ENGLISH)))


PARTS = {"chat_logs": CHAT_LOGS, "log_events": LOG_EVENTS, "shared_chats": SHARED_CHATS, "messages": MESSAGES}
NEEDS = {"log_events": ("chat_logs",), "messages": ("chat_logs",)}


def _with(name: str, spark: bool) -> str:
    parts = [*NEEDS.get(name, ()), name]
    return ", ".join(f"{p} AS ({_sql(PARTS[p], spark)})" for p in parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables under ``sf_dir``."""
    text = f"WITH {_with(name, True)} SELECT * FROM {name}".replace("FROM conversations", "FROM {conversations}")
    return spark.sql(text, conversations=table(spark, sf_dir, "conversations"))


def oracle_with(*names: str) -> str:
    """The WITH clause that gives DuckDB the views."""
    parts: list[str] = []
    for name in names:
        parts += [p for p in (*NEEDS.get(name, ()), name) if p not in parts]
    return "WITH " + ", ".join(f"{p} AS ({_sql(PARTS[p], False)})" for p in parts)
