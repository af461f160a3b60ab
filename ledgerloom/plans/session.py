"""Queries on sessions: turns, windows, later use, evidence, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import session
from ..streaming import turns, verdicts
from ..workload import query

_E = "event_type"
_ORDER = ("ts", "event_id")


@query("conversations", sql="WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations) SELECT conv_id, CAST(turn_no AS BIGINT) AS turn_no, count(*) AS events, count(*) FILTER (role = 'assistant') AS agent, min(turn) AS opens, lead(min(turn)) OVER (PARTITION BY conv_id ORDER BY turn_no) AS closes FROM t WHERE turn_no > 0 GROUP BY conv_id, turn_no")
def turn_windows(conversations: DataFrame) -> DataFrame:
    rows = session.numbered_turns(conversations, "conv_id", F.col("role") == "user", "turn")
    turns = rows.groupBy("conv_id", "turn_no").agg(F.count("*").alias("events"), F.count_if(F.col("role") == "assistant").alias("agent"), F.min("turn").alias("opens"))
    return turns.withColumn("closes", F.lead("opens").over(W.partitionBy("conv_id").orderBy("turn_no")))


@query("conversations", sql="WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn FROM t WHERE role = 'user' AND before = 'user'")
def awaiting_verdict(conversations: DataFrame) -> DataFrame:
    rows = conversations.withColumn("before", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    return rows.filter("role = 'user' and before = 'user'").select("conv_id", "turn")


@query("events", sql="SELECT event_id, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL AS owned, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS owner FROM events QUALIFY event_type = 'click'")
def as_of_call_owner(events: DataFrame) -> DataFrame:
    owner = session.last_before("user_id", F.col("event_id"), F.col(_E) == "view", *_ORDER)
    rows = events.withColumn("owner", owner).filter(F.col(_E) == "click")
    return rows.select("event_id", F.col("owner").isNotNull().alias("owned"), "owner")


@query("events", sql="SELECT event_id, coalesce(bool_or(event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS used FROM events QUALIFY event_type = 'view'")
def used_later(events: DataFrame) -> DataFrame:
    rows = events.withColumn("used", session.later_within("user_id", F.col(_E) == "click", *_ORDER))
    return rows.filter(F.col(_E) == "view").select("event_id", "used")


@query("events", sql="SELECT event_id, first_value(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ends FROM events QUALIFY event_type = 'view'")
def first_following(events: DataFrame) -> DataFrame:
    rows = events.withColumn("ends", session.first_following("user_id", F.col("event_id"), F.col(_E).isin("purchase", "error"), *_ORDER))
    return rows.filter(F.col(_E) == "view").select("event_id", "ends")


@query("events", sql="WITH t AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn_no FROM events) SELECT user_id, CAST(turn_no AS BIGINT) AS turn_no, count(*) FILTER (event_type = 'view') AS injected, count(*) FILTER (event_type = 'purchase') AS edits FROM t WHERE turn_no > 0 GROUP BY ALL")
def interval_join_turns(events: DataFrame) -> DataFrame:
    rows = session.numbered_turns(events, "user_id", F.col(_E) == "signup", *_ORDER)
    return rows.groupBy("user_id", "turn_no").agg(F.count_if(F.col(_E) == "view").alias("injected"), F.count_if(F.col(_E) == "purchase").alias("edits"))


@query("events", sql="SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / nullif(count(*), 0), 6) AS share FROM events GROUP BY ROLLUP (event_type)")
def usage_rollup(events: DataFrame) -> DataFrame:
    high = F.count_if(F.col("value") > 50)
    return events.rollup(_E).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.try_divide(high, F.count("*")), 6).alias("share"))


@query("events", sql="WITH c AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS c, count(DISTINCT event_type) AS kinds FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT user_id, c AS confirmed, round(c / (c + 2), 6) AS confidence, c / (c + 2) >= 0.6 AND kinds >= 2 AS hard FROM c")
def confidence_hard(events: DataFrame) -> DataFrame:
    seen = events.filter("event_type <> 'error'").groupBy("user_id").agg(F.countDistinct(F.col("ts").cast("date")).alias("confirmed"), F.countDistinct(_E).alias("kinds"))
    confidence = F.col("confirmed") / (F.col("confirmed") + 2)
    return seen.select("user_id", "confirmed", F.round(confidence, 6).alias("confidence"), ((confidence >= 0.6) & (F.col("kinds") >= 2)).alias("hard"))


@query("events", sql="SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100")
def last_100_per_key(events: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("r", rank).filter("r <= 100").select("user_id", "event_id")


@query("events", sql="WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events) SELECT event_id, CASE WHEN last >= now - INTERVAL 7 DAY THEN props END AS kept FROM events JOIN l USING (user_id), m")
def retention_erase(events: DataFrame) -> DataFrame:
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    now = events.agg(F.max("ts").alias("now"))
    rows = events.join(last, "user_id").crossJoin(F.broadcast(now))
    return rows.select("event_id", F.when(F.col("last") >= F.col("now") - F.expr("interval 7 days"), F.col("props")).alias("kept"))


@query("events", sql="WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, no")
def session_gaps(events: DataFrame) -> DataFrame:
    gaps = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return gaps.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("events", stream=True, sql="WITH t AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn_no FROM events), g AS (SELECT user_id, CAST(turn_no AS BIGINT) AS turn_no, count(*) FILTER (event_type = 'view') AS injected, count(*) FILTER (event_type = 'purchase') AS edits FROM t WHERE turn_no > 0 GROUP BY ALL) SELECT * FROM g QUALIFY lead(turn_no) OVER (PARTITION BY user_id ORDER BY turn_no) IS NOT NULL")
def stream_turns(events: DataFrame) -> DataFrame:
    """The settled turns that a stream of the same events gives."""
    return turns.drained(turns.settled_turns(events), "turns")


#: What events stand for in a session of their user: signups open turns, purchases judge them, errors end the session.
_KINDS = "CASE event_type WHEN 'signup' THEN 'prompt' WHEN 'purchase' THEN 'verdict' WHEN 'error' THEN 'end' ELSE 'other' END"
WAIT_DAYS = 2


@query(
    "events",
    stream=True,
    sql=f"WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, CAST(event_id AS VARCHAR) AS id, ts, {_KINDS} AS kind, value > 50 AS correction FROM events), m AS (SELECT max(ts) - INTERVAL 10 SECOND AS mark FROM e), "
    "d AS (SELECT *, lead(struct_pack(id := id, ts := ts, kind := kind, correction := correction)) OVER (PARTITION BY session ORDER BY ts, id) AS judge FROM e WHERE kind <> 'other'), "
    "t AS (SELECT *, first_value(CASE WHEN kind IN ('prompt', 'end') THEN struct_pack(ts := ts, kind := kind, judge := judge) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM d QUALIFY kind = 'prompt'), "
    f"l AS (SELECT session, max(ts) AS last FROM e GROUP BY 1), v AS (SELECT t.session, id AS turn, CASE WHEN next.kind = 'end' THEN 'session_end' WHEN next.judge IS NULL THEN CASE WHEN greatest(last, mark) >= next.ts + INTERVAL {WAIT_DAYS} DAY THEN 'withheld' END WHEN next.judge.ts >= next.ts + INTERVAL {WAIT_DAYS} DAY OR next.judge.kind = 'prompt' THEN 'withheld' WHEN next.judge.kind = 'end' THEN 'session_end' WHEN next.judge.correction THEN 'correction' ELSE 'no_correction' END AS verdict FROM t JOIN l USING (session), m WHERE next IS NOT NULL) "
    "SELECT 'verdict:' || sha256(session || chr(10) || turn) AS id, session, turn, verdict FROM v WHERE verdict IS NOT NULL",
)
def stream_verdicts(events: DataFrame) -> DataFrame:
    """The verdicts that a stream of the same events gives."""
    kind = F.when(F.col(_E) == "signup", "prompt").when(F.col(_E) == "purchase", "verdict").when(F.col(_E) == "error", "end").otherwise("other")
    rows = events.select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("string").alias("id"), kind.alias("kind"), (F.col("value") > 50).alias("correction"))
    return turns.drained(verdicts.verdicts(rows, wait=WAIT_DAYS * 24 * 3600, idle=400 * 24 * 3600), "verdicts")
