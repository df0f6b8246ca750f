"""The conversation log: history, lists, search, ownership, sharing, and its updates as latest rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.scalars import normal_email, snippet, stripped, text_of

LISTED, CANDIDATES, HITS = 20, 200, 10


def session_history(logs: DataFrame, session_id: str | None = None) -> DataFrame:
    """The log rows of one session, or of all, in order of time, then of arrival."""
    rows = logs if session_id is None else logs.where(F.col("session_id") == session_id)
    return rows.select("session_id", "log_id", "user_name", "user_prompt", "response", "image_base64", "image_mime_type", "image_filename", "pdf_url", "timestamp_utc", "seq").orderBy("session_id", "timestamp_utc", "seq")


def _named(logs: DataFrame) -> DataFrame:
    return logs.where("session_id is not null and session_id <> ''")


def sessions(logs: DataFrame) -> DataFrame:
    """Last activity and number of messages of each user's sessions."""
    return _named(logs).groupBy("user_email", "session_id").agg(F.max("timestamp_utc").alias("last_activity"), F.count("*").alias("message_count"))


def session_list(logs: DataFrame, email: str, limit: int = LISTED) -> DataFrame:
    """One user's latest sessions."""
    own = sessions(logs.where(F.col("user_email") == normal_email(F.lit(email))))
    return own.orderBy(F.desc("last_activity"), F.desc("session_id")).limit(limit).drop("user_email")


def _first(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= most)


def session_lists(logs: DataFrame, limit: int = LISTED) -> DataFrame:
    """Every user's latest sessions with their rank."""
    return _first(sessions(logs), ["user_email"], [F.desc("last_activity"), F.desc("session_id")], limit).withColumnRenamed("rn", "rank")


def session_search(logs: DataFrame, query: str, limit: int = HITS) -> DataFrame:
    """Every user's sessions with the text in a prompt or response, newest first.

    Only the newest 200 matching rows of a user are looked at; a session's count comes from the user's 20
    latest sessions and is 0 beyond them. % and _ in the text are wildcards.
    """
    query = query.strip()
    low = F.lit(query.lower())
    newest = [F.desc("timestamp_utc"), F.desc("seq")]
    matching = _named(logs).where(F.lower("user_prompt").like(f"%{query.lower()}%") | F.lower("response").like(f"%{query.lower()}%"))
    recent = _first(matching, ["user_email"], newest, CANDIDATES)
    one = _first(recent.drop("rn"), ["user_email", "session_id"], newest, 1).drop("rn")
    best = _first(one, ["user_email"], newest, limit)
    meta = session_lists(logs).select("user_email", "session_id", "last_activity", "message_count")
    prompt, response = stripped(F.col("user_prompt")), stripped(F.col("response"))
    source = F.when(F.contains(F.lower(prompt), low), prompt).when(F.contains(F.lower(response), low), response).when(prompt != "", prompt).otherwise(response)
    joined = best.join(meta, ["user_email", "session_id"], "left")
    return joined.select("user_email", "session_id", F.coalesce("last_activity", "timestamp_utc").alias("last_activity"), F.coalesce("message_count", F.lit(0)).cast("long").alias("message_count"), snippet(source).alias("snippet"), F.col("rn").alias("rank"))


def session_ownership(pairs: DataFrame, logs: DataFrame, strict: bool = False) -> DataFrame:
    """``pairs`` (session_id, user_email) with belongs; an empty address owns everything unless ``strict``."""
    owned = logs.select("session_id", "user_email").distinct().withColumn("found", F.lit(True))
    joined = pairs.withColumn("email__", normal_email(F.col("user_email"))).join(owned.withColumnRenamed("user_email", "email__"), ["session_id", "email__"], "left")
    belongs = F.coalesce("found", F.lit(False))
    return joined.select("session_id", "user_email", (belongs if strict else (F.col("email__") == "") | belongs).alias("belongs"))


def share_insert(requests: DataFrame, logs: DataFrame, now: Column, token: Column | None = None) -> DataFrame:
    """The answer to each request to share a session: 400 without a session, 403 if it is another's, 404 if it has no log rows, else 200 and the new record.

    ``requests`` has session_id and user_email. A token is 32 random bytes as URL text, unless ``token`` says another.
    """
    random = F.translate(F.base64(F.unhex(F.replace(F.concat(F.uuid(), F.uuid()), F.lit("-"), F.lit("")))), "+/=\n", "-_")
    asked = requests.select(stripped(F.col("session_id")).alias("session_id"), normal_email(F.col("user_email")).alias("user_email")).distinct()
    held = logs.select("session_id").distinct().withColumn("held", F.lit(True))
    status = F.when(F.col("session_id") == "", 400).when(~F.col("belongs"), 403).when(F.col("held").isNull(), 404).otherwise(200).cast("int")
    rows = session_ownership(asked, logs).join(held, "session_id", "left").withColumn("status", status)
    good = F.col("status") == 200
    return rows.select("session_id", "user_email", "status", F.when(good, random if token is None else token).alias("share_token"), F.when(good, now).alias("created_at_utc"), good.alias("is_active"))


def share_lookup(shares: DataFrame, token: str) -> DataFrame:
    """The record of one share token."""
    return shares.where(F.col("share_token") == token).limit(1)


def share_status(shares: DataFrame, now: Column) -> DataFrame:
    """Each share's HTTP status: 404 inactive, 410 past, 200 valid; no expiry is never past."""
    status = F.when(~F.coalesce("is_active", F.lit(False)), 404).when(F.col("expires_at_utc") < now, 410).otherwise(200)
    return shares.select("share_token", "session_id", status.cast("int").alias("status"))


def shared_messages(shares: DataFrame, logs: DataFrame, now: Column) -> DataFrame:
    """The log rows that valid shares show."""
    valid = share_status(shares, now).where("status = 200").select("share_token", "session_id")
    return valid.join(logs, "session_id").select("share_token", "session_id", "log_id", "user_prompt", "response", "timestamp_utc", "seq")


def latest_by_key(events: DataFrame, key: str, order: str) -> DataFrame:
    """An append log as table: the last row of each key, all its columns, nulls too.

    One aggregate with partial results, so a key with very many events is no task's burden.
    """
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(key, "row.*")


def latest_keeping(events: DataFrame, key: str, order: str, kept: tuple[str, ...]) -> DataFrame:
    """The same, but the columns ``kept`` keep their last value that isn't null."""
    rest = [c for c in events.columns if c != key and c not in kept]
    held = [F.max_by(F.struct(F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"k_{c}") for c in kept]
    rows = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"), *held)
    return rows.select(key, "row.*", *[F.col(f"k_{c}")[c].alias(c) for c in kept])


def apply_ratings(logs: DataFrame, ratings: DataFrame) -> DataFrame:
    """The log with each row's last rating; a rating moves the row's time too."""
    last = latest_by_key(ratings, "log_id", "timestamp_utc").select("log_id", F.col("stars").alias("r_stars"), F.col("timestamp_utc").alias("r_time"))
    rated = logs.join(last, "log_id", "left")
    return rated.select(*[c for c in logs.columns if c not in ("stars", "timestamp_utc")], F.coalesce("r_stars", "stars").alias("stars"), F.coalesce("r_time", "timestamp_utc").alias("timestamp_utc"))


def without_tombstones(logs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The log without deleted rows."""
    return logs.join(tombstones.select("log_id").distinct(), "log_id", "left_anti")


def attach_images(logs: DataFrame, images: DataFrame) -> DataFrame:
    """The log with images attached by (log_id, user_name): a data prefix goes, bad base64 gives null."""
    body = F.regexp_replace(text_of(F.col("image")), r"^data:[^,]*,", "")
    given = images.select("log_id", "user_name", F.try_to_binary(body, F.lit("BASE64")).alias("image_blob"))
    return logs.join(given, ["log_id", "user_name"], "left")


def image_bytes(blob: Column, base64: Column) -> Column:
    """A stored image: its bytes, or else its base64 text decoded."""
    return F.coalesce(blob, F.try_to_binary(base64, F.lit("BASE64")))


def evolve(logs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The log with the columns that an older one lacks, as nulls."""
    for name, kind in columns.items():
        if name not in logs.columns:
            logs = logs.withColumn(name, F.lit(None).cast(kind))
    return logs
