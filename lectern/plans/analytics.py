"""Beyond the reference's own operators: joins, rollups, windows and event streams over the star schema, as Spark has them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import intervals as I
from lectern.operators import sketches as H
from lectern.operators import variants as J
from lectern.session import table
from lectern.streaming import events as E


def _money():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _pricing(s, d):
    rows = table(s, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(_money()), 2).alias("revenue"), F.count("*").alias("lines"))


def _revenue_by_nation(s, d):
    """The dimension tables are fixed in size by the schema; the larger joins are left to the optimizer."""
    orders, customer = table(s, d, "orders"), table(s, d, "customer")
    nation = F.broadcast(table(s, d, "nation"))
    rows = table(s, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(_money()), 2).alias("revenue"))


def _rollup(s, d):
    rows = table(s, d, "part").rollup("p_brand", "p_size").agg(F.count("*").alias("parts"), F.grouping_id().cast("int").alias("level"))
    return rows.select("p_brand", "p_size", "parts", "level")


def _idle_customers(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def _top_orders(s, d):
    order = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def _spans(s, d):
    """Each user's sessions as intervals of seconds, from the first event to the last."""
    rows = E.session_spans(table(s, d, "events"))
    return rows.select("user_id", "session_start", I.seconds(F.col("session_start")).alias("begins"), I.seconds(F.col("session_end")).alias("ends"))


def _session_company(s, d):
    """For each session the events of all users while it lasted, and how many of them were errors."""
    spans, events = _spans(s, d), table(s, d, "events").select("event_type", I.seconds(F.col("ts")).alias("at"))
    counted = events.select("at", F.lit(1).alias("events"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("errors"))
    return I.sums_within(spans, counted, "begins", "ends", "at", ["events", "errors"]).where("events > 0").select("user_id", "session_start", "events", "errors")


def _sessions_at_once(s, d):
    """For each session how many sessions of others overlap it. A user's sessions lie apart, so all that overlap it are others' but itself."""
    own = I.overlap_counts(_spans(s, d).where("user_id is not null"), "begins", "ends", "all")
    return own.where("all > 1").select("user_id", "session_start", (F.col("all") - 1).alias("sessions"))


def _after_errors(s, d):
    """Purchases within ten minutes after an error of the same user."""
    events = table(s, d, "events").select("event_id", "user_id", "event_type", I.seconds(F.col("ts")).alias("at"))
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("at").alias("begins"), (F.col("at") + 600).alias("ends"))
    bought = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "at")
    return I.with_points(errors, bought, "begins", "ends", "at", ["user_id"], width=600.0).select("error_id", "purchase_id")


def _shipped_in_window(s, d):
    """Lines of orders that are shipped within their order's 30 to 60 days, by priority."""
    day = 86_400.0
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("order"), "o_orderpriority", (I.seconds(F.col("o_orderdate")) + 30 * day).alias("begins"), (I.seconds(F.col("o_orderdate")) + 60 * day).alias("ends"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("order"), I.seconds(F.col("l_shipdate")).alias("at"))
    return I.with_points(orders, lines, "begins", "ends", "at", ["order"], width=30 * day).groupBy("o_orderpriority").agg(F.count("*").alias("lines"))


def _daily(s, d):
    """Sketches of events by day and type, as they would be stored."""
    rows = table(s, d, "events").withColumn("day", F.to_date("ts")).withColumn("prop", F.get_json_object("props", "$.k"))
    return H.sketched(rows, ["day", "event_type"], "user_id", "value", "prop")


def _sketch_report(s, d):
    """By event type, from the days' sketches alone: users, quantiles of the values and the most frequent property."""
    return H.estimates(H.merged(_daily(s, d), ["event_type"]), ["event_type"])


def _sketch_errors(s, d):
    """The report held against exact figures: whether each lies within its sketch's bounds (three standard errors of the distinct count; ranks within 2 percent)."""
    events = table(s, d, "events")
    exact = events.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    sketches = _sketch_report(s, d)
    ranks = events.join(sketches.select("event_type", "q50", "q90"), "event_type").groupBy("event_type").agg(*[F.avg((F.col("value") < F.col(q)).cast("double")).alias(f"under_{q}") for q in ("q50", "q90")], *[F.avg((F.col("value") <= F.col(q)).cast("double")).alias(f"upto_{q}") for q in ("q50", "q90")])
    rank_ok = lambda q, p: ((F.col(f"under_{q}") <= p + 0.02) & (F.col(f"upto_{q}") >= p - 0.02)).alias(f"{q}_within")
    error = 3 * 1.04 / 2 ** (H.DISTINCT_K / 2)
    rows = exact.join(sketches, "event_type").join(ranks, "event_type")
    return rows.select("event_type", "events", (F.col("n") == F.col("events")).alias("counted"), (F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), error * F.col("users"))).alias("users_within"), rank_ok("q50", 0.5), rank_ok("q90", 0.9))


def _frequent(s, d):
    """How often each property came on each day, from the sketches by day and type: fewer values than a sketch tracks are counted exactly."""
    days = H.merged(_daily(s, d), ["day"])
    return days.select("day", F.explode(F.expr("approx_top_k_estimate(frequent_sketch, 1000)")).alias("t")).select("day", F.col("t.item").alias("item"), F.col("t.count").alias("n"))


def _props(s, d):
    return table(s, d, "events").select("event_type", J.parsed(F.col("props")).alias("props"))


def _document_facts(s, d):
    """Open metadata of documents, with keys and kinds that differ from row to row."""
    n = F.col("doc_id")
    facts = F.concat_ws(
        ",",
        F.concat(F.lit('"source":"'), "source", F.lit('"')),
        F.when(n % 2 == 0, F.concat(F.lit('"grade":'), (n % 12).cast("string"))).when(n % 3 == 0, '"grade":"all"').when(n % 5 == 0, '"grade":null'),
        F.when(n % 7 == 0, F.concat(F.lit('"pages":['), (n % 4).cast("string"), F.lit("]"))),
        F.when(n % 11 == 0, '"flags":{"checked":true}'),
    )
    whole = F.when(n % 13 == 0, "not json").when(n % 17 == 0, "[1]").otherwise(F.concat(F.lit("{"), facts, F.lit("}")))
    return table(s, d, "documents").select("doc_id", "lang", J.parsed(whole).alias("facts"))


QUERIES = {
    "pricing_summary": _pricing,
    "revenue_by_nation": _revenue_by_nation,
    "part_rollup": _rollup,
    "idle_customers": _idle_customers,
    "top_orders": _top_orders,
    "event_windows": lambda s, d: E.windows(table(s, d, "events")),
    "event_sessions": lambda s, d: E.sessions(table(s, d, "events")),
    "event_as_of": lambda s, d: E.as_of(table(s, d, "events")),
    "sketch_report": _sketch_report,
    "sketch_errors": _sketch_errors,
    "frequent_props": _frequent,
    "props_profile": lambda s, d: J.profile(_props(s, d), "props", ["event_type"]),
    "props_values": lambda s, d: _props(s, d).select("event_type", F.try_variant_get("props", "$.k", "long").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most")),
    "document_facts": lambda s, d: J.profile(_document_facts(s, d), "facts", ["lang"]),
    "session_company": _session_company,
    "sessions_at_once": _sessions_at_once,
    "purchases_after_errors": _after_errors,
    "shipped_in_window": _shipped_in_window,
}

SPANS = """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f),
 spans AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end FROM n GROUP BY user_id, session)"""

ORACLES = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "part_rollup": "SELECT p_brand, p_size, count(*) AS parts, CAST(grouping_id(p_brand, p_size) AS INT) AS level FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "idle_customers": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "top_orders": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders QUALIFY rank <= 3",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": "SELECT user_id, min(ts) AS session_start, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session",
    "event_as_of": "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events",
    "sketch_errors": "SELECT event_type, count(*) AS events, TRUE AS counted, TRUE AS users_within, TRUE AS q50_within, TRUE AS q90_within FROM events GROUP BY event_type",
    "frequent_props": "SELECT CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS item, count(*) AS n FROM events GROUP BY ALL",
    "props_profile": "SELECT event_type, key, 'number' AS kind, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL",
    "props_values": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "document_facts": """WITH f AS (SELECT lang, unnest([{'key': 'source', 'kind': 'string'}, {'key': 'grade', 'kind': CASE WHEN doc_id % 2 = 0 THEN 'number' WHEN doc_id % 3 = 0 THEN 'string' WHEN doc_id % 5 = 0 THEN 'null' END},
  {'key': 'pages', 'kind': CASE WHEN doc_id % 7 = 0 THEN 'array' END}, {'key': 'flags', 'kind': CASE WHEN doc_id % 11 = 0 THEN 'object' END}], recursive := true) FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0)
 SELECT lang, key, kind, count(*) AS n FROM f WHERE kind IS NOT NULL GROUP BY ALL""",
    "session_company": f"{SPANS} SELECT s.user_id, session_start, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM spans s JOIN events e ON e.ts BETWEEN session_start AND session_end GROUP BY ALL",
    "sessions_at_once": f"{SPANS} SELECT a.user_id, a.session_start, count(*) AS sessions FROM spans a JOIN spans b ON a.user_id <> b.user_id AND b.session_start <= a.session_end AND a.session_start <= b.session_end GROUP BY ALL",
    "purchases_after_errors": "SELECT a.event_id AS error_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 10 MINUTE",
    "shipped_in_window": "SELECT o_orderpriority, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate + INTERVAL 30 DAY AND o_orderdate + INTERVAL 60 DAY GROUP BY ALL",
}
