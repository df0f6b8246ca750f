"""Queries on conversation logs, turns, messages and the question bank."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import lessons as P
from lectern.functions import routing as R
from lectern.functions import scalars as S
from lectern.operators import chat_logs as L
from lectern.operators import containment as C
from lectern.operators import faq as Q
from lectern.operators import turns as T
from lectern.session import spread, table
from lectern.sources.fixtures import oracle_with, view

USER = "user1@students.example"
TERM = "the"
NOW = "2024-06-01 00:00:00"


def _logs(spark, d):
    return view(spark, d, "chat_logs")


def _messages(spark, d):
    return view(spark, d, "messages")


def _ratings(logs):
    return logs.where("seq % 7 = 0").select("log_id", ((F.col("seq") + 1) % 6).cast("int").alias("stars"), (F.col("timestamp_utc") + F.expr("interval 1 day")).alias("timestamp_utc"))


def _per_message(**columns):
    """A query that gives one value for each message."""
    return lambda spark, d: _messages(spark, d).select("msg_id", *[c(F.col("text")).alias(n) for n, c in columns.items()])


def _requests(spark, d):
    """The messages as requests: some cancelled, with a page's address or a staged file, and what retrieval answered."""
    rows = _role_of(_messages(spark, d))
    pending = T.pending_images(rows, R.image_intent(F.col("text")), R.is_image_request(F.col("text"))).select("msg_id", F.lit(True).alias("was"))
    bank = Q.faq_substring(rows).select("msg_id", F.lit(True).alias("hit"))
    answers = _logs(spark, d).select(F.col("seq").cast("long").alias("msg_id"), F.col("response").alias("answer"))
    rows = rows.join(pending, "msg_id", "left").join(bank, "msg_id", "left").join(answers, "msg_id", "left")
    n = F.abs("msg_id")
    return rows.withColumns({"url": F.when(n % 11 == 3, " page.example/x ").when(n % 11 == 4, " "), "staged": F.when(n % 13 == 2, "notes.pdf").when(n % 13 == 3, ""), "cancelled": n % 17 == 5, "document": n % 5 == 0})


def _cascade(spark, d):
    none = F.lit(False)
    step = R.answer_cascade(F.col("text"), F.col("role"), cancelled=F.col("cancelled"), url=F.col("url"), pending_image=F.coalesce("was", none), faq_hit=F.coalesce("hit", none), answer=F.col("answer"), has_document=F.col("document"))
    return _requests(spark, d).select("msg_id", step.alias("route"))


def _share_requests(logs):
    n = F.col("seq") % 7
    return logs.select(F.when(n == 0, " ").when(n == 1, "no-such").otherwise(F.col("session_id")).alias("session_id"), F.when(n == 2, "other@students.example").when(n == 1, "").otherwise(F.col("user_email")).alias("user_email"))


def _role_of(messages):
    return messages.withColumn("role", S.access_role(F.col("user_email")))


def _minutes(s, d):
    """The minutes that each message asks for, 40 where it names none."""
    asked = P.requested_minutes(R.lesson_metadata(F.col("text"))["duration"])
    return _messages(s, d).select("msg_id", F.coalesce(asked, F.lit(40)).alias("minutes"))


def _lesson_plans(s, d):
    """The answer to each message, in the lesson template where a lesson was asked for."""
    answers = _logs(s, d).select(F.col("seq").cast("long").alias("msg_id"), F.col("response").alias("answer"))
    return _messages(s, d).join(answers, "msg_id", "left").select("msg_id", P.lesson_plan(F.col("answer"), F.col("text")).alias("plan"))


def _plain_words(text):
    # what is kept is gathered: replacing what isn't took six times as long
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9 ]+"), F.lit(0)), "")


#: Numbers of the large bank's texts begin here, behind those of the short one.
LARGE = 1000


def _bank_matches(s, d):
    """For each message about the assistant the first question that it holds or lies in, of the short bank and then of a large one."""
    large = table(s, d, "benchmark").select((LARGE + F.col("item_id")).alias("id"), Q.faq_normal(F.col("text")).alias("text"))
    bank = Q.bank(s).select(F.col("ord").cast("long").alias("id"), F.col("question").alias("text")).unionByName(large)
    return C.first_phrase(Q.asked(_messages(s, d)).toDF("id", "text"), bank).toDF("msg_id", "ord")


def _bank_in_documents(s, d):
    """The texts of the bank that each document holds, or that hold it."""
    docs = spread(table(s, d, "documents")).select(F.col("doc_id").alias("id"), _plain_words(F.col("text")).alias("text"))
    bank = table(s, d, "benchmark").select(F.col("item_id").alias("id"), _plain_words(F.col("text")).alias("text"))
    return C.containing(docs, bank).distinct().select(F.col("text_id").alias("doc_id"), F.col("phrase_id").alias("item_id"))


QUERIES = {
    "session_list": lambda s, d: L.session_lists(_logs(s, d)).select("user_email", "session_id", "last_activity", "message_count", "rank"),
    "session_list_one": lambda s, d: L.session_list(_logs(s, d), USER),
    "session_history": lambda s, d: L.session_history(_logs(s, d)),
    "session_search": lambda s, d: L.session_search(_logs(s, d), TERM),
    "session_ownership": lambda s, d: L.session_ownership(_logs(s, d).select("session_id", F.when(F.col("seq") % 5 == 0, "").when(F.col("seq") % 5 == 1, "other@students.example").otherwise(F.col("user_email")).alias("user_email")).distinct(), _logs(s, d)),
    "share_lookup": lambda s, d: L.share_lookup(view(s, d, "shared_chats"), "token-10"),
    "share_status": lambda s, d: L.share_status(view(s, d, "shared_chats"), F.lit(NOW).cast("timestamp_ntz")),
    "shared_messages": lambda s, d: L.shared_messages(view(s, d, "shared_chats"), _logs(s, d), F.lit(NOW).cast("timestamp_ntz")),
    "log_upsert_latest": lambda s, d: L.latest_by_key(view(s, d, "log_events"), "log_id", "op_seq"),
    "log_upsert_keeping": lambda s, d: L.latest_keeping(view(s, d, "log_events"), "log_id", "op_seq", ("image_filename",)),
    "apply_ratings": lambda s, d: L.apply_ratings(_logs(s, d), _ratings(_logs(s, d))).select("log_id", "stars", "timestamp_utc"),
    "log_tombstones": lambda s, d: L.without_tombstones(_logs(s, d), _logs(s, d).where("seq % 11 = 0")).select("log_id", "session_id"),
    "image_attach": lambda s, d: L.attach_images(_logs(s, d), _logs(s, d).where("seq % 3 = 0").select("log_id", "user_name", F.lit("data:image/png;base64,aGVsbG8=").alias("image"))).select("log_id", F.hex("image_blob").alias("image_hex")),
    "image_fetch": lambda s, d: _logs(s, d).select("log_id", F.hex(L.image_bytes(F.lit(None).cast("binary"), F.col("image_base64"))).alias("image_hex")),
    "log_evolve": lambda s, d: L.evolve(_logs(s, d).drop("pdf_url"), {"pdf_url": "string", "stars": "int"}).select("log_id", "pdf_url", "stars"),
    "log_to_turns": lambda s, d: T.log_to_turns(_logs(s, d)),
    "turns_with_assets": lambda s, d: T.turns_with_assets(_logs(s, d)),
    "turn_pairs": lambda s, d: T.turn_pairs(table(s, d, "conversations")),
    "history_fallback": lambda s, d: T.with_fallback(T.log_to_turns(_logs(s, d).where("seq % 2000 < 1000")).select("session_id", "role", "content"), table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"))),
    "session_transcript": lambda s, d: T.transcripts(table(s, d, "conversations")),
    "session_doc_buffer": lambda s, d: T.document_buffers(table(s, d, "documents").withColumn("grp", F.col("doc_id") % 100), "grp", "doc_id", "doc_id", "text"),
    "user_facts": lambda s, d: T.user_facts(_messages(s, d)),
    "pending_image": lambda s, d: T.pending_images(_messages(s, d), R.image_intent(F.col("text")), R.is_image_request(F.col("text"))),
    "cancelled_turns": lambda s, d: table(s, d, "conversations").select("conv_id", "turn").join(table(s, d, "conversations").where("conv_id % 10 = 3 and turn = 2").select("conv_id", "turn"), ["conv_id", "turn"], "left_anti"),
    "email_norm": lambda s, d: _messages(s, d).select("msg_id", S.normal_email(F.concat(F.lit(" \t"), F.upper("user_email"), F.lit("\n"))).alias("email")),
    "access_role": lambda s, d: _messages(s, d).select("msg_id", S.access_role(F.when(F.col("msg_id") % 5 == 0, "nobody").when(F.col("msg_id") % 5 == 1, "a.education@x@y").otherwise(F.col("user_email"))).alias("role")),
    "snippet": _per_message(snippet=S.snippet),
    "iso_to_utc": lambda s, d: _messages(s, d).select("msg_id", S.iso_to_utc(F.when(F.col("msg_id") % 3 == 0, "2024-05-06T07:08:09Z").when(F.col("msg_id") % 3 == 1, "2024-05-06T07:08:09+02:00").otherwise("2024-05-06T07:08:09")).alias("at")),
    "md_escape": _per_message(escaped=S.escape_markdown),
    "md_clean": _per_message(cleaned=S.clean_markdown),
    "disclaimer": lambda s, d: _logs(s, d).select("log_id", S.with_disclaimer(F.col("response")).alias("answer")),
    "weak_answer": lambda s, d: _logs(s, d).select("log_id", S.weak_answer(F.col("response")).alias("weak")),
    "is_math": _per_message(hit=R.is_math),
    "is_reasoning": _per_message(hit=R.is_reasoning),
    "is_web": _per_message(hit=R.is_web),
    "web_query_clean": _per_message(query=R.web_query),
    "is_image_request": _per_message(hit=R.is_image_request),
    "image_intent": _per_message(intent=R.image_intent, shown=R.image_text),
    "all_but_n": _per_message(number=R.all_but_number),
    "is_lesson": _per_message(hit=R.is_lesson),
    "route_action": lambda s, d: _role_of(_messages(s, d)).select("msg_id", R.route(F.col("text"), F.col("role")).alias("action"), R.route_status(R.route(F.col("text"), F.col("role"))).alias("status")),
    "route_histogram": lambda s, d: R.route_histogram(_role_of(_messages(s, d)), F.col("role")),
    "answer_route": lambda s, d: _role_of(_messages(s, d)).select("msg_id", R.answer_route(F.col("text"), F.col("role"), Q.is_self_query(F.col("text"))).alias("route")),
    "all_but_answer": _per_message(answer=R.all_but_answer),
    "image_prompt": lambda s, d: _messages(s, d).where(R.is_image_request(F.col("text"))).select("msg_id", R.image_prompt(F.col("text"), R.image_intent(F.col("text")), R.image_text(F.col("text"))).alias("prompt")),
    "chat_action": lambda s, d: _requests(s, d).select("msg_id", R.chat_action(F.col("text"), F.col("role"), F.col("staged"), F.col("url")).alias("action")),
    "answer_cascade": _cascade,
    "faq_answer": lambda s, d: Q.faq_answer(_messages(s, d)),
    "share_insert": lambda s, d: L.share_insert(_share_requests(_logs(s, d)), _logs(s, d), F.lit(NOW).cast("timestamp_ntz"), F.sha2(F.col("session_id"), 256)),
    "fact_maps": lambda s, d: T.fact_maps(T.user_facts(_messages(s, d))).select("user_email", F.to_json("facts").alias("facts")),
    "is_self_query": _per_message(hit=Q.is_self_query),
    "lesson_metadata": lambda s, d: _messages(s, d).select("msg_id", *[c.alias(n) for n, c in R.lesson_metadata(F.col("text")).items()]),
    "lesson_metadata_all": lambda s, d: _messages(s, d).select("msg_id", *[c.alias(n) for n, c in R.lesson_metadata(F.col("text")).items()]),
    "lesson_timing": lambda s, d: _minutes(s, d).select("msg_id", "minutes", *[c.alias(n) for n, c in R.lesson_timing(F.col("minutes")).items()]),
    "lesson_plans": _lesson_plans,
    "expand_contractions": _per_message(expanded=Q.expand_contractions),
    "faq_normalize": _per_message(normal=Q.faq_normal),
    "faq_canonicalize": _per_message(canonical=Q.faq_canonical),
    "faq_substring_match": lambda s, d: Q.faq_substring(_messages(s, d)),
    "faq_jaccard": lambda s, d: Q.faq_jaccard(_messages(s, d)),
    "faq_best_match": lambda s, d: Q.faq_best(_messages(s, d)),
    "faq_candidates": lambda s, d: Q.faq_candidates(_messages(s, d)),
    "faq_bounds": lambda s, d: Q.faq_pairs(_messages(s, d)).select("msg_id", F.col("ord").cast("long").alias("ord"), F.round("bound", 6).alias("bound"), (F.col("bound") >= Q.FUZZY - 1e-9).alias("scored")),
    "bank_matches": _bank_matches,
    "bank_in_documents": _bank_in_documents,
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(value: str, parts) -> str:
    return "(" + " OR ".join(f"contains({value}, {_q(p)})" for p in parts) + ")"


STRIP = r"regexp_replace(regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


def _strip(value: str) -> str:
    return STRIP.format(value)


def _flat(value: str) -> str:
    return rf"regexp_replace({_strip(value)}, '[\s\p{{Z}}]+', ' ', 'g')"


def _snippet(value: str) -> str:
    flat = _flat(value)
    return rf"CASE WHEN length({flat}) <= 140 THEN {flat} ELSE concat(regexp_replace(substring({flat}, 1, 139), '[\s\p{{Z}}]+$', ''), '…') END"


def _role(email: str) -> str:
    e = f"lower({_strip(email)})"
    return f"CASE WHEN contains({e}, '@') THEN CASE WHEN starts_with(regexp_replace({e}, '^[^@]*@', ''), 'education.') OR contains(split_part({e}, '@', 1), '.education') THEN 'teacher' ELSE 'student' END END"


def _m(select: str, where: str = "TRUE") -> str:
    return f"{oracle_with('messages')} SELECT msg_id, {select} FROM messages WHERE {where}"


def _l(rest: str, *more: str) -> str:
    return f"{oracle_with('chat_logs', *more)} {rest}"


LOW, RAW = f"lower({_strip('text')})", "lower(coalesce(text, ''))"
MATH = f"({_any(RAW, R.MATH_SIGNALS)} OR regexp_matches({RAW}, {_q(R.ARITHMETIC)}) OR (" + " + ".join(f"CAST(contains({RAW}, {_q(c)}) AS INT)" for c in "∫∑√^=") + ") >= 2)"
REASON, WEB = _any(LOW, R.REASONING_SIGNALS), _any(LOW, R.WEB_SIGNALS)
NOUNS, PAIRS = R.image_request_pattern()
IMAGE = f"(regexp_matches({LOW}, {_q(NOUNS)}) OR regexp_matches({LOW}, {_q(PAIRS)}))"
INTENT = f"CASE WHEN {_any(LOW, R.NO_TEXT)} THEN 'no_text' WHEN regexp_matches({_strip('text')}, {_q(R.QUOTED)}) OR {_any(LOW, R.WANTS_TEXT)} THEN 'wants_text' WHEN {_any(LOW, R.AMBIGUOUS)} THEN 'ambiguous' ELSE 'no_text' END"
ALL_BUT = f"CASE WHEN {_any(LOW, R.ALL_BUT_SIGNALS)} THEN regexp_extract({LOW}, {_q(R.ALL_BUT)}, 1) ELSE '' END"
ROLE = _role("user_email")
ACTION = f"""CASE WHEN {_any(RAW, R.LESSON[:4])} AND {ROLE} IS DISTINCT FROM 'teacher' THEN 'lesson-plan-blocked' WHEN {_any(RAW, R.LESSON[:4])} THEN 'lesson-plan'
 WHEN {_any(RAW, R.NOTES)} THEN 'short-notes' WHEN contains({RAW}, 'pdf') THEN 'pdf' WHEN {_any(RAW, R.IMAGE_WORDS)} THEN 'image' WHEN contains({RAW}, 'wiki') THEN 'wikipedia' WHEN {WEB} THEN 'web' ELSE 'general' END"""


def _expanded() -> str:
    out = RAW
    for old, new in (*Q.CONTRACTIONS, *Q.PHRASES):
        out = rf"regexp_replace({out}, {_q(chr(92) + 'b' + old + chr(92) + 'b')}, {_q(new)}, 'g')"
    return out


EXPANDED = _expanded()
#: The messages with their expanded, normal and canonical text, one step at a time.
CANONICAL = "CASE WHEN normal = '' THEN '' " + " ".join(f"WHEN contains(normal, {_q(Q.plain_normal(a))}) THEN {_q(c)}" for a, c in Q.ALIASES) + " ELSE normal END"
BANK = "(VALUES " + ", ".join(f"({i}, {_q(q)}, {_q(a)}, {_q(Q.plain_normal(q))})" for i, (q, a) in enumerate(Q.BANK)) + ") AS bank(ord, question, answer, qnormal)"


def _faq(rest: str) -> str:
    normal = f"regexp_replace(lower({_strip('expanded')}), '[^a-z0-9 ]+', '', 'g')"
    return f"""{oracle_with('messages')}, e AS (SELECT msg_id, {EXPANDED} AS expanded FROM messages), n AS (SELECT *, {normal} AS normal FROM e),
 c AS (SELECT *, {CANONICAL} AS canonical, {_any('lower(expanded)', Q.SELF_SIGNALS)} AS own FROM n) {rest}"""


def _tok(value: str) -> str:
    return f"list_distinct(list_filter(string_split({value}, ' '), lambda t: length(t) > 2))"


def _renormal(value: str) -> str:
    out = f"lower({value})"
    for old, new in (*Q.CONTRACTIONS, *Q.PHRASES):
        out = rf"regexp_replace({out}, {_q(chr(92) + 'b' + old + chr(92) + 'b')}, {_q(new)}, 'g')"
    return f"regexp_replace(lower(trim({out})), '[^a-z0-9 ]+', '', 'g')"


SESSIONS = "SELECT user_email, session_id, max(timestamp_utc) AS last_activity, count(*) AS message_count FROM chat_logs WHERE session_id <> '' GROUP BY ALL"
LISTS = f"SELECT *, CAST(row_number() OVER (PARTITION BY user_email ORDER BY last_activity DESC, session_id DESC) AS INT) AS rank FROM ({SESSIONS}) QUALIFY rank <= 20"
QUOTE = "replace(replace(replace(url_encode({0}), '*', '%2A'), '%20', '+'), '%7E', '~')"
FACT_A, FACT_B = (f"regexp_extract(text, {_q(p)}, [{_q('a')}, {_q('b')}])" for p in (T.FACT, T.CALLED))


def _clean(value: str) -> str:
    return rf"""regexp_replace(regexp_replace({_strip(value)}, '^[."]+', ''), '[."]+$', '')"""


def _fact(pattern: str) -> tuple[str, str, str]:
    term, meaning = f"upper({_clean(f'regexp_extract(text, {_q(pattern)}, 1)')})", _clean(f"regexp_extract(text, {_q(pattern)}, 2)")
    return f"(regexp_matches(text, {_q(pattern)}) AND length({term}) BETWEEN 2 AND 10 AND length({meaning}) BETWEEN 3 AND 120)", term, meaning


(A, AT, AM), (B, BT, BM) = _fact(T.FACT), _fact(T.CALLED)
POINTS = "CASE WHEN canonical = qnormal THEN 100 ELSE 0 END + CASE WHEN starts_with(qnormal, canonical) THEN 30 ELSE 0 END + CASE WHEN starts_with(canonical, qnormal) THEN 20 ELSE 0 END + 6 * len(list_intersect({0}, {1})) + ".format(_tok("canonical"), _tok("qnormal")) + " + ".join(
    f"CASE WHEN question = {_q(c)} AND (contains(canonical, {_q(Q.plain_normal(a))}) OR contains({_q(Q.plain_normal(a))}, canonical)) THEN 10 ELSE 0 END" for a, c in Q.ALIASES
)
ESCAPED = "coalesce(text, '')"
for _char, _entity in S.ENTITIES:
    ESCAPED = f"replace({ESCAPED}, {_q(_char)}, {_q(_entity)})"
NAMED = f"regexp_matches(text, {_q(R.TOPIC)})"
TOPIC = rf"{_strip('regexp_replace(' + _strip(f'regexp_extract(text, {_q(R.TOPIC)}, 1)') + r", '(?i)\s+for\b.*', '')")}"
PART = "greatest({1}, CAST(round_even(CAST(minutes AS DOUBLE) * CAST({0} AS DOUBLE), 0) AS INT))"
PARTS = {"intro": PART.format(0.12, 3), "direct": PART.format(0.30, 8), "guided": PART.format(0.30, 8), "independent": PART.format(0.18, 5)}
TIMES = ", ".join(f"CAST(CASE WHEN minutes >= 10 THEN {e} ELSE {d} END AS INT) AS {n}" for (n, e), d in zip(PARTS.items(), (5, 15, 10, 7))) + ", CAST(CASE WHEN minutes >= 10 THEN greatest(3, minutes - (" + " + ".join(PARTS.values()) + ")) ELSE 3 END AS INT) AS closure"

ORACLES = {
    "session_list": _l(LISTS),
    "session_list_one": _l(f"SELECT session_id, last_activity, message_count FROM ({SESSIONS}) WHERE user_email = {_q(USER)} ORDER BY last_activity DESC, session_id DESC LIMIT 20"),
    "session_history": _l("SELECT session_id, log_id, user_name, user_prompt, response, image_base64, image_mime_type, image_filename, pdf_url, timestamp_utc, seq FROM chat_logs ORDER BY session_id, timestamp_utc, seq"),
    "session_search": _l(
        f""", meta AS ({LISTS}), hits AS (SELECT * FROM chat_logs WHERE session_id <> '' AND (lower(user_prompt) LIKE '%{TERM}%' OR lower(response) LIKE '%{TERM}%')
 QUALIFY row_number() OVER (PARTITION BY user_email ORDER BY timestamp_utc DESC, seq DESC) <= 200),
 one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY user_email, session_id ORDER BY timestamp_utc DESC, seq DESC) = 1),
 best AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_email ORDER BY timestamp_utc DESC, seq DESC) AS INT) AS rank FROM one QUALIFY rank <= 10),
 src AS (SELECT *, CASE WHEN contains(lower(user_prompt), '{TERM}') THEN user_prompt WHEN contains(lower(response), '{TERM}') THEN response WHEN user_prompt <> '' THEN user_prompt ELSE response END AS s FROM best)
 SELECT src.user_email, src.session_id, coalesce(meta.last_activity, timestamp_utc) AS last_activity, coalesce(meta.message_count, 0) AS message_count, {_snippet('s')} AS snippet, src.rank
 FROM src LEFT JOIN meta USING (user_email, session_id)"""
    ),
    "session_ownership": _l(
        """, p AS (SELECT DISTINCT session_id, CASE WHEN seq % 5 = 0 THEN '' WHEN seq % 5 = 1 THEN 'other@students.example' ELSE user_email END AS user_email FROM chat_logs)
 SELECT session_id, user_email, user_email = '' OR EXISTS (SELECT 1 FROM chat_logs l WHERE l.session_id = p.session_id AND l.user_email = p.user_email) AS belongs FROM p"""
    ),
    "share_lookup": f"{oracle_with('shared_chats')} SELECT * FROM shared_chats WHERE share_token = 'token-10' LIMIT 1",
    "share_status": f"{oracle_with('shared_chats')} SELECT share_token, session_id, CAST(CASE WHEN NOT is_active THEN 404 WHEN expires_at_utc < TIMESTAMP '{NOW}' THEN 410 ELSE 200 END AS INT) AS status FROM shared_chats",
    "shared_messages": f"{oracle_with('shared_chats', 'chat_logs')} SELECT share_token, session_id, log_id, user_prompt, response, timestamp_utc, seq FROM shared_chats JOIN chat_logs USING (session_id) WHERE is_active AND (expires_at_utc IS NULL OR expires_at_utc >= TIMESTAMP '{NOW}')",
    "log_upsert_latest": f"{oracle_with('log_events')} SELECT * FROM log_events QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY op_seq DESC) = 1",
    "log_upsert_keeping": f"{oracle_with('log_events')} SELECT * EXCLUDE (k) REPLACE (k AS image_filename) FROM (SELECT *, last_value(image_filename IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY op_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS k FROM log_events QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY op_seq DESC) = 1)",
    "apply_ratings": _l("SELECT log_id, CAST(CASE WHEN seq % 7 = 0 THEN (seq + 1) % 6 ELSE stars END AS INT) AS stars, CASE WHEN seq % 7 = 0 THEN timestamp_utc + INTERVAL 1 DAY ELSE timestamp_utc END AS timestamp_utc FROM chat_logs"),
    "log_tombstones": _l("SELECT log_id, session_id FROM chat_logs WHERE seq % 11 <> 0"),
    "image_attach": _l("SELECT log_id, CASE WHEN seq % 3 = 0 THEN '68656C6C6F' END AS image_hex FROM chat_logs"),
    "image_fetch": _l("SELECT log_id, hex(from_base64(image_base64)) AS image_hex FROM chat_logs"),
    "log_evolve": _l("SELECT log_id, CAST(NULL AS VARCHAR) AS pdf_url, stars FROM chat_logs"),
    "log_to_turns": _l(f"SELECT session_id, seq, 0 AS part, 'user' AS role, {_strip('user_prompt')} AS content FROM chat_logs WHERE {_strip('user_prompt')} <> '' UNION ALL SELECT session_id, seq, 1, 'assistant', {_strip('response')} FROM chat_logs WHERE {_strip('response')} <> ''"),
    "turns_with_assets": _l(
        f"SELECT session_id, seq, {_strip('response')} AS content, image_mime_type, CASE WHEN image_filename IS NOT NULL THEN concat('/assets/', {QUOTE.format('image_filename')}) WHEN image_base64 IS NOT NULL THEN concat('/api/chat-image/', log_id, '?user_name=', {QUOTE.format('user_name')}) END AS image_url, pdf_url FROM chat_logs WHERE {_strip('response')} <> ''"
    ),
    "turn_pairs": "SELECT conv_id, turn, text AS prompt, CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS response FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'",
    "history_fallback": _l(
        f""", h AS (SELECT session_id, 'user' AS role, {_strip('user_prompt')} AS content FROM chat_logs WHERE seq % 2000 < 1000 AND {_strip('user_prompt')} <> '' UNION ALL SELECT session_id, 'assistant', {_strip('response')} FROM chat_logs WHERE seq % 2000 < 1000 AND {_strip('response')} <> '')
 SELECT * FROM h UNION ALL SELECT CAST(conv_id AS VARCHAR), role, text FROM conversations WHERE CAST(conv_id AS VARCHAR) NOT IN (SELECT session_id FROM h)"""
    ),
    "session_transcript": "SELECT conv_id, count(*) AS turns, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id",
    "session_doc_buffer": "SELECT doc_id % 100 AS grp, substring(string_agg(concat('--- Document: ', doc_id, ' ---', chr(10), text), chr(10) || chr(10) ORDER BY doc_id), 1, 12000) AS buffer FROM documents GROUP BY 1",
    "user_facts": f"{oracle_with('messages')} SELECT user_email, term, arg_max(definition, ord) AS definition FROM (SELECT user_email, ord, CASE WHEN {A} THEN {AT} ELSE {BT} END AS term, CASE WHEN {A} THEN {AM} ELSE {BM} END AS definition FROM messages WHERE {A} OR {B}) GROUP BY ALL",
    "pending_image": f"{oracle_with('messages')} SELECT msg_id, session_id, pending, text AS reply FROM (SELECT *, lag(text) OVER w AS pending, lag({IMAGE} AND {INTENT} = 'ambiguous') OVER w AS was FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY ord, msg_id)) WHERE was",
    "cancelled_turns": "SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 10 = 3 AND turn = 2)",
    "email_norm": _m("lower(user_email) AS email"),
    "access_role": _m(_role("CASE WHEN ((msg_id % 5) + 0) = 0 THEN 'nobody' WHEN msg_id % 5 = 1 THEN 'a.education@x@y' ELSE user_email END") + " AS role"),
    "snippet": _m(_snippet("text") + " AS snippet"),
    "iso_to_utc": _m("CASE WHEN msg_id % 3 = 1 THEN TIMESTAMP '2024-05-06 05:08:09' ELSE TIMESTAMP '2024-05-06 07:08:09' END AS at"),
    "md_escape": _m(f"regexp_replace({ESCAPED}, {_q(S.MARKDOWN)}, {_q(chr(92) * 2 + chr(92) + '1')}, 'g') AS escaped"),
    "md_clean": _m("translate(coalesce(text, ''), '*_`~<>', '') AS cleaned"),
    "disclaimer": _l(rf"SELECT log_id, CASE WHEN contains(response, {_q(S.DISCLAIMER)}) THEN response WHEN regexp_replace(response, '[\s\p{{Z}}]+$', '') = '' THEN {_q(S.DISCLAIMER)} ELSE concat(regexp_replace(response, '[\s\p{{Z}}]+$', ''), chr(10), chr(10), '---', chr(10), chr(10), {_q(S.DISCLAIMER)}) END AS answer FROM chat_logs"),
    "weak_answer": _l(f"SELECT log_id, length(lower({_strip('response')})) < 40 OR {_any('lower(' + _strip('response') + ')', S.WEAK_SIGNALS)} AS weak FROM chat_logs"),
    "is_math": _m(f"{MATH} AS hit"),
    "is_reasoning": _m(f"{REASON} AS hit"),
    "is_web": _m(f"{WEB} AS hit"),
    "web_query_clean": _m(f"CASE WHEN regexp_replace({_strip('text')}, {_q(R.WEB_COMMAND)}, '') <> '' THEN regexp_replace({_strip('text')}, {_q(R.WEB_COMMAND)}, '') ELSE text END AS query"),
    "is_image_request": _m(f"{IMAGE} AS hit"),
    "image_intent": _m(f"{INTENT} AS intent, CASE WHEN {_any(LOW, R.NO_TEXT)} THEN '' ELSE {_strip(f'regexp_extract({_strip(chr(116) + chr(101) + chr(120) + chr(116))}, {_q(R.QUOTED)}, 1)')} END AS shown"),
    "all_but_n": _m(f"{ALL_BUT} AS number"),
    "is_lesson": _m(f"{_any(RAW, R.LESSON)} AS hit"),
    "route_action": f"SELECT msg_id, action, CASE action " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in R.STATUS.items()) + f" END AS status FROM ({_m(ACTION + ' AS action')})",
    "route_histogram": f"SELECT action, count(*) AS messages FROM ({_m(ACTION + ' AS action')}) GROUP BY action",
    "answer_route": _faq(
        f"SELECT m.msg_id, CASE WHEN {_any(RAW, R.LESSON)} AND {ROLE} IS DISTINCT FROM 'teacher' THEN 'lesson-blocked' WHEN {ALL_BUT} <> '' THEN 'all-but' WHEN {MATH} THEN 'math' WHEN own THEN 'faq' WHEN NOT {MATH} AND NOT {REASON} AND contains({RAW}, 'wiki') THEN 'wikipedia' WHEN NOT {MATH} AND NOT {REASON} AND {WEB} THEN 'web' ELSE 'retrieval' END AS route FROM messages m JOIN c USING (msg_id)"
    ),
    "is_self_query": _faq("SELECT msg_id, own AS hit FROM c"),
    "lesson_metadata": _m(
        rf"CASE WHEN regexp_extract(text, {_q(R.GRADE)}, 1) <> '' THEN concat('Grade ', regexp_extract(text, {_q(R.GRADE)}, 1)) ELSE '' END AS grade, regexp_extract(text, {_q(R.DURATION)}, 1) AS duration, CASE WHEN {NAMED} THEN {TOPIC} ELSE '' END AS topic, CASE WHEN {NAMED} THEN CASE WHEN len(regexp_split_to_array({TOPIC}, '\s+')) <= 3 THEN {TOPIC} ELSE '' END ELSE {_strip(f'regexp_extract(text, {_q(R.SUBJECT)}, 1)')} END AS subject, {_strip(f'regexp_extract(text, {_q(R.PREREQUISITE)}, 1)')} AS prerequisite",
    ),
    "lesson_timing": oracle_with("messages") + f" SELECT msg_id, minutes, {TIMES} FROM (SELECT msg_id, coalesce(TRY_CAST(regexp_extract(regexp_extract(text, {_q(R.DURATION)}, 1), '[0-9]+') AS INT), 40) AS minutes FROM messages)",
    "expand_contractions": _faq("SELECT msg_id, expanded FROM c"),
    "faq_normalize": _faq("SELECT msg_id, normal FROM c"),
    "faq_canonicalize": _faq("SELECT msg_id, canonical FROM c"),
    "faq_substring_match": _faq(f"SELECT msg_id, arg_min(question, ord) AS question, arg_min(answer, ord) AS answer FROM c JOIN {BANK} ON contains(canonical, question) OR contains(question, canonical) WHERE own AND canonical <> '' GROUP BY msg_id"),
    "faq_jaccard": _faq(f", r AS (SELECT msg_id, {_renormal('canonical')} AS asked FROM c WHERE own AND canonical <> '') SELECT msg_id, CAST(ord AS BIGINT) AS ord, round(len(list_intersect({_tok('asked')}, {_tok('qnormal')}))::DOUBLE / greatest(len(list_distinct(list_concat({_tok('asked')}, {_tok('qnormal')}))), 1), 6) AS overlap FROM r, {BANK}"),
    "faq_candidates": _faq(f"SELECT msg_id, question, CAST({POINTS} AS INT) AS points, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY points DESC, question) AS INT) AS rank FROM c, {BANK} WHERE canonical <> '' AND points > 0 QUALIFY rank <= 12"),
}
ORACLES["lesson_metadata_all"] = ORACLES["lesson_metadata"]
ORACLES["all_but_answer"] = f"SELECT msg_id, CASE WHEN n <> '' THEN concat('The answer is ', n, {_q(". Because 'all but ")}, n, {_q("' means every one except ")}, n, ' is gone, so ', n, ' are left.') ELSE '' END AS answer FROM ({_m(ALL_BUT + ' AS n')})"
ORACLES["image_prompt"] = f"""SELECT msg_id, CASE WHEN intent <> 'wants_text' THEN concat(text, '. Clean, high-quality illustration with NO text, NO words, NO letters, no captions, no labels, no watermark. High resolution.')
 WHEN shown <> '' THEN concat(text, '. Clean professional design. IMPORTANT: display the exact text "', shown, '", spelled correctly, sharp and clearly readable. No other text, no random letters. High resolution.')
 ELSE concat(text, '. Clean professional design with the requested wording spelled correctly and clearly readable. No random or extra text. High resolution.') END AS prompt
 FROM ({ORACLES["image_intent"].replace(" AS shown", " AS shown, text").replace("WHERE TRUE", "WHERE " + IMAGE)})"""
URL = "CASE WHEN abs(msg_id) % 11 = 3 THEN ' page.example/x ' WHEN abs(msg_id) % 11 = 4 THEN ' ' END"
ORACLES["chat_action"] = _m(f"CASE WHEN trim(coalesce({URL}, '')) <> '' THEN 'web' WHEN abs(msg_id) % 13 = 2 THEN 'document' ELSE {ACTION} END AS action")
ORACLES["answer_cascade"] = _faq(
    f""", p AS (SELECT msg_id AS p_id FROM (SELECT *, lag({IMAGE} AND {INTENT} = 'ambiguous') OVER w AS was FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY ord, msg_id)) WHERE was),
 h AS (SELECT DISTINCT msg_id AS h_id FROM c JOIN {BANK} ON contains(canonical, question) OR contains(question, canonical) WHERE own AND canonical <> ''),
 a AS (SELECT seq AS a_id, response FROM chat_logs)
 SELECT msg_id, CASE WHEN abs(msg_id) % 17 = 5 THEN 'cancelled' WHEN abs(msg_id) % 11 = 3 THEN 'url'
 WHEN {_any(RAW, R.LESSON[:4])} AND {ROLE} IS DISTINCT FROM 'teacher' THEN 'lesson-blocked' WHEN p_id IS NOT NULL THEN 'pending-image' WHEN {ALL_BUT} <> '' THEN 'all-but' WHEN {MATH} THEN 'math'
 WHEN h_id IS NOT NULL THEN 'faq' WHEN NOT {REASON} AND contains({RAW}, 'wiki') THEN 'wikipedia' WHEN NOT {REASON} AND {WEB} THEN 'web'
 WHEN abs(msg_id) % 5 <> 0 AND (length(lower({_strip('response')})) < 40 OR {_any('lower(' + _strip('response') + ')', S.WEAK_SIGNALS)}) THEN 'retrieval-to-web' ELSE 'retrieval' END AS route
 FROM messages LEFT JOIN p ON p_id = msg_id LEFT JOIN h ON h_id = msg_id LEFT JOIN a ON a_id = msg_id"""
)
ORACLES["share_insert"] = _l(
    f""", r AS (SELECT DISTINCT CASE WHEN seq % 7 = 0 THEN '' WHEN seq % 7 = 1 THEN 'no-such' ELSE session_id END AS session_id, CASE WHEN seq % 7 = 2 THEN 'other@students.example' WHEN seq % 7 = 1 THEN '' ELSE user_email END AS user_email FROM chat_logs),
 s AS (SELECT *, CAST(CASE WHEN session_id = '' THEN 400 WHEN user_email <> '' AND NOT EXISTS (SELECT 1 FROM chat_logs l WHERE l.session_id = r.session_id AND l.user_email = r.user_email) THEN 403
 WHEN NOT EXISTS (SELECT 1 FROM chat_logs l WHERE l.session_id = r.session_id) THEN 404 ELSE 200 END AS INT) AS status FROM r)
 SELECT session_id, user_email, status, CASE WHEN status = 200 THEN sha256(session_id) END AS share_token, CASE WHEN status = 200 THEN TIMESTAMP '{NOW}' END AS created_at_utc, status = 200 AS is_active FROM s"""
)
ORACLES["fact_maps"] = f"SELECT user_email, concat('{{', string_agg(concat(to_json(term), ':', to_json(definition)), ',' ORDER BY term, definition), '}}') AS facts FROM ({ORACLES['user_facts']}) GROUP BY user_email"


def _normal(table_: str, keys: str) -> str:
    """Rows with faq_normal of their text."""
    out = "lower(coalesce(text, ''))"
    for old, new in (*Q.CONTRACTIONS, *Q.PHRASES):
        out = rf"regexp_replace({out}, {_q(chr(92) + 'b' + old + chr(92) + 'b')}, {_q(new)}, 'g')"
    return f"SELECT {keys}, regexp_replace(lower({_strip('expanded')}), '[^a-z0-9 ]+', '', 'g') AS t FROM (SELECT {keys}, {out} AS expanded FROM {table_})"


HOLDS = "a.t <> '' AND b.t <> '' AND (contains(a.t, b.t) OR contains(b.t, a.t))"
LARGE_BANK = f"SELECT ord, question AS t FROM {BANK} UNION ALL SELECT {LARGE} + item_id, t FROM ({_normal('benchmark', 'item_id')})"
ORACLES["bank_matches"] = _faq(f", a AS (SELECT msg_id, canonical AS t FROM c WHERE own), b AS ({LARGE_BANK}) SELECT msg_id, CAST(min(ord) AS BIGINT) AS ord FROM a JOIN b ON {HOLDS} GROUP BY msg_id")
PLAIN = "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]+', '', 'g') AS t"
ORACLES["bank_in_documents"] = f"WITH a AS (SELECT doc_id, {PLAIN} FROM documents), b AS (SELECT item_id, {PLAIN} FROM benchmark) SELECT doc_id, item_id FROM a JOIN b ON {HOLDS}"

BONUS = " OR ".join(f"(question = {_q(c)} AND (contains(asked, {_q(Q.plain_normal(a))}) OR contains({_q(Q.plain_normal(a))}, asked)))" for a, c in Q.ALIASES)
OVERLAP = f"len(list_intersect({_tok('asked')}, {_tok('qnormal')}))::DOUBLE / greatest(len(list_distinct(list_concat({_tok('asked')}, {_tok('qnormal')}))), 1)"
SAME = f"list_sum(list_transform(string_split({_q(Q.LETTERS)}, ''), lambda x: least(length(asked) - length(replace(asked, x, '')), length(qnormal) - length(replace(qnormal, x, '')))))"
ORACLES["faq_bounds"] = _faq(f""", r AS (SELECT msg_id, {_renormal('canonical')} AS asked FROM c WHERE own AND canonical <> ''), b AS (SELECT msg_id, CAST(ord AS BIGINT) AS ord,
 1.4 * {SAME} / (length(asked) + length(qnormal)) + 0.3 * {OVERLAP} + CASE WHEN {BONUS} THEN 0.12 ELSE 0 END AS bound FROM r, {BANK} WHERE asked <> '')
 SELECT msg_id, ord, round(bound, 6) AS bound, bound >= {Q.FUZZY} - 1e-9 AS scored FROM b""")


def _filled(template: str, value) -> str:
    return "concat(" + ", ".join(value(part) if name else _q(part) for part, name in P.pieces(template)) + ")"


def _plan_sql() -> str:
    cell = lambda n: f"coalesce(nullif({_strip(f'regexp_replace(replace({n}, chr(124), chr(92) || chr(124)), chr(91) || chr(10) || chr(13) || chr(93), chr(32), chr(103))')}, ''), {_q(P.MISSING)})"
    value = lambda n: n if n in ("intro", "direct", "guided", "independent", "closure") else f"CASE WHEN topic = '' THEN 'Lesson Plan' ELSE {cell('topic')} END" if n == "title" else cell(n)
    facts = ORACLES["lesson_metadata"].split(" SELECT msg_id, ", 1)
    lesson = ORACLES["is_lesson"].split(" SELECT msg_id, ", 1)[1]
    return f"""{oracle_with("messages", "chat_logs")}, facts AS (SELECT msg_id, {facts[1]}), lessons AS (SELECT msg_id, {lesson}),
 given AS (SELECT * REPLACE (CASE WHEN duration = '' THEN {_q(P.MINUTES)} ELSE duration END AS duration) FROM facts), timed AS (SELECT *, coalesce(TRY_CAST(regexp_extract(duration, '[0-9]+') AS INT), 0) AS minutes FROM given),
 parts AS (SELECT *, {TIMES} FROM timed), answers AS (SELECT seq AS msg_id, response AS answer, {_strip("response")} AS draft FROM chat_logs)
 SELECT p.msg_id, CASE WHEN hit THEN concat({_filled(P.TEMPLATE, value)}, CASE WHEN coalesce(draft, '') = '' THEN '' ELSE {_filled(P.DRAFT, lambda n: n)} END) ELSE coalesce(answer, '') END AS plan
 FROM parts p JOIN lessons l ON l.msg_id = p.msg_id LEFT JOIN answers a ON a.msg_id = p.msg_id"""


ORACLES["lesson_plans"] = _plan_sql()
