"""Conversations as turns, and what is remembered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.scalars import plus_quoted, stripped, text_of

BUFFER = 12_000
#: What states that a term means something.
FACT = r"(?i)\b([A-Z]{2,6})\s+(?:stands for|means|is short for|refers to|is)\s+(.+)"
CALLED = r"(?i)\b(.+?)\s+is\s+(?:called|known as)\s+(.+)"


def log_to_turns(logs: DataFrame) -> DataFrame:
    """Each log row as a user turn and an assistant turn; blank ones are left out."""
    pair = F.array(F.struct(F.lit("user").alias("role"), stripped(F.col("user_prompt")).alias("content")), F.struct(F.lit("assistant").alias("role"), stripped(F.col("response")).alias("content")))
    return logs.select("session_id", "seq", F.posexplode(pair).alias("part", "turn")).where("turn.content <> ''").select("session_id", "seq", F.col("part").cast("int"), "turn.role", "turn.content")


def image_url(logs: DataFrame) -> Column:
    """Where a row's image lies: its file, or else the stored one; null without either."""
    name, encoded, log, user = (stripped(F.col(c)) for c in ("image_filename", "image_base64", "log_id", "user_name"))
    stored = (encoded != "") & (log != "") & (user != "")
    return F.when(name != "", F.concat(F.lit("/assets/"), plus_quoted(name))).when(stored, F.concat(F.lit("/api/chat-image/"), log, F.lit("?user_name="), plus_quoted(user)))


def turns_with_assets(logs: DataFrame) -> DataFrame:
    """The assistant turns with image and file addresses."""
    rows = logs.where(stripped(F.col("response")) != "")
    return rows.select("session_id", "seq", stripped(F.col("response")).alias("content"), "image_mime_type", image_url(rows).alias("image_url"), "pdf_url")


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right behind it; unanswered ones have the empty response."""
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumn("next_role", F.lead("role").over(order)).withColumn("next_text", F.lead("text").over(order)).where("role = 'user'")
    return rows.select("conv_id", "turn", F.col("text").alias("prompt"), F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("").alias("response"))


def with_fallback(history: DataFrame, memory: DataFrame) -> DataFrame:
    """Turns from the log, and from memory for sessions that the log lacks."""
    return history.unionByName(memory.join(history.select("session_id").distinct(), "session_id", "left_anti"), allowMissingColumns=True)


def transcripts(conversations: DataFrame) -> DataFrame:
    """Each conversation as one text, a line for each turn."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def _joined(parts: DataFrame, key: str, order: str, section: Column, limit: int, shortest: int) -> DataFrame:
    """For each key the first ``limit`` characters of its sections, a blank line between two, in their order.

    Sections have ``shortest`` characters at least, so only so many of a key's first ones can be in them: each task passes on no more than those, and a key with very many parts is no single task's burden.
    """
    most = limit // (shortest + 2) + 1
    rows = parts.select(key, F.col(order).alias("at"), F.substring(section, 1, limit).alias("part"))
    first = rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("at", "part"))).where(F.col("rank") <= most)
    own = F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"])
    return first.groupBy(key).agg(F.substring(F.array_join(own, "\n\n"), 1, limit).alias("buffer"))


def document_buffers(parts: DataFrame, key: str, order: str, name: str, text: str, limit: int = BUFFER) -> DataFrame:
    """For each key its documents one behind the other under their names, the first ``limit`` characters."""
    section = F.concat(F.lit("--- Document: "), F.col(name).cast("string"), F.lit(" ---\n"), text_of(F.col(text)))
    return _joined(parts, key, order, section, limit, len("--- Document:  ---\n"))


def session_buffers(parts: DataFrame, key: str, order: str, limit: int = BUFFER) -> DataFrame:
    """For each key what was read in it, files and web pages, each under its name and without white space at its end; the first ``limit`` characters.

    ``parts`` has kind (Document or Web page), name and text. An empty text leaves its heading alone.
    """
    headed = F.concat(F.lit("--- "), "kind", F.lit(": "), F.col("name").cast("string"), F.lit(" ---\n"), text_of(F.col("text")))
    return _joined(parts, key, order, F.regexp_replace(headed, r"(?U)\s+$", ""), limit, len("--- :  ---"))


def append_turns(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """``sessions`` (conv_id, turns: array of role, content) with new ``turns`` (conv_id, turn, role, text) behind their own; unknown sessions begin with theirs."""
    fresh = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    added = turns.groupBy("conv_id").agg(F.transform(fresh, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("added"))
    none = F.expr("cast(array() as array<struct<role:string,content:string>>)")
    return sessions.join(added, "conv_id", "full").select("conv_id", F.concat(F.coalesce("turns", none), F.coalesce("added", none)).alias("turns"))


def user_fact(message: Column) -> tuple[Column, Column, Column]:
    """(whether a fact is stated, term, definition): of two patterns the first that holds with lengths in bounds."""
    found = []
    for pattern in (FACT, CALLED):
        clean = lambda c: F.regexp_replace(stripped(c), r'^[."]+|[."]+$', "")
        term, meaning = F.upper(clean(F.regexp_extract(message, pattern, 1))), clean(F.regexp_extract(message, pattern, 2))
        found.append((F.rlike(message, F.lit(pattern)) & F.length(term).between(2, 10) & F.length(meaning).between(3, 120), term, meaning))
    (a, at, am), (b, bt, bm) = found
    return a | b, F.when(a, at).otherwise(bt), F.when(a, am).otherwise(bm)


def user_facts(messages: DataFrame) -> DataFrame:
    """The last definition of each term that each user stated."""
    text = text_of(F.col("text"))
    stated, term, meaning = user_fact(text)
    rows = messages.where((text_of(F.col("user_email")) != "") & stated).select("user_email", "ord", term.alias("term"), meaning.alias("definition"))
    return rows.groupBy("user_email", "term").agg(F.max_by("definition", "ord").alias("definition"))


def fact_maps(facts: DataFrame) -> DataFrame:
    """One map of terms for each user."""
    return facts.groupBy("user_email").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "definition")))).alias("facts"))


def pending_images(messages: DataFrame, intent: Column, request: Column) -> DataFrame:
    """Messages that answer an unclear image request right before them, with the request."""
    order = W.partitionBy("session_id").orderBy("ord", "msg_id")
    rows = messages.withColumn("unclear", request & (intent == "ambiguous"))
    rows = rows.withColumn("pending", F.lag("text").over(order)).withColumn("was", F.coalesce(F.lag("unclear").over(order), F.lit(False)))
    return rows.where("was").select("msg_id", "session_id", "pending", F.col("text").alias("reply"))
