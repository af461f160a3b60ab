"""Queries on what a session is given: cut-offs, packing, ledgers, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import packing, session
from ..workload import query
from .retrieval import _COST, _PIECES

_SKIP = "f.cnt < 4 AND f.total + o.n <= 600"
_FOLD = "WITH RECURSIVE {o}, f(k, r, id, taken, cnt, total) AS (SELECT k, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, 0, CAST(0 AS BIGINT) FROM o WHERE r = 1 UNION ALL SELECT o.k, o.r, o.id, {c}, f.cnt + CASE WHEN {c} THEN 1 ELSE 0 END, f.total + CASE WHEN {c} THEN o.n ELSE 0 END FROM f JOIN o ON o.k = f.k AND o.r = f.r + 1) "
_SIZE = f"CAST(ceil(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform({_PIECES}, lambda w: {_COST})), lambda s, x: s + x)) AS BIGINT)"


def _key() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


@query("conversations", sql="SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 20 AND sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 600")
def batch_cutoff(conversations: DataFrame) -> DataFrame:
    return packing.prefix_within(conversations, "conv_id", F.length("text"), 20, 600, "turn").select("conv_id", "turn")


@query("conversations", sql=_FOLD.format(o="o AS (SELECT conv_id AS k, turn AS id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)", c=_SKIP) + "SELECT k AS conv_id, id AS turn FROM f WHERE taken")
def context_skip_fold(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.length("text").alias("n"))
    return packing.skip_fold(rows, "conv_id", F.col("n"), 4, 600, "turn").select("conv_id", "turn")


@query("documents", "labels", sql=_FOLD.format(o=f"d AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY coalesce(quality, 0) DESC, doc_id) AS copy, coalesce(quality, 0) AS priority FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL AND source IS NOT NULL), o AS (SELECT source AS k, doc_id AS id, {_SIZE} AS n, row_number() OVER (PARTITION BY source ORDER BY priority DESC, doc_id) AS r FROM d WHERE copy = 1)", c="f.total + o.n <= 2000") + "SELECT k AS source, id AS doc_id FROM f WHERE taken")
def budget_pack(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Each source's documents into 2,000 tokens, better ones first, one of each text. Texts don't travel: their sizes do."""
    said = F.md5(F.trim(F.regexp_replace("text", r"\s+", " ")).cast("binary"))
    rows = documents.filter("text is not null and source is not null").select("doc_id", "source", said.alias("said"), text.token_estimate(F.col("text")).alias("n"))
    rows = rows.join(labels.select("doc_id", "quality"), "doc_id", "left").withColumn("priority", -F.coalesce("quality", F.lit(0)))
    once = rows.groupBy("source", "said").agg(F.min(F.struct("priority", "doc_id", "n")).alias("best")).select("source", "best.*")
    return packing.skip_fold(once, "source", F.col("n"), 1 << 60, 2000, "priority", "doc_id").select("source", "doc_id")


@query("events", sql="WITH f AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS key, min(event_id) AS first FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT user_id, key, first, row_number() OVER (PARTITION BY user_id ORDER BY first) AS pos, row_number() OVER (PARTITION BY user_id ORDER BY first DESC) <= 256 AS held FROM f")
def delivery_ledger(events: DataFrame) -> DataFrame:
    seen = packing.ledger(events.filter("event_type = 'view'").select("user_id", _key().alias("key"), "event_id"), "user_id", "key", "event_id")
    return seen.withColumn("pos", F.col("pos").cast("long"))


@query("events", sql="WITH d AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT user_id, k, last FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last DESC) <= 5")
def recent_distinct(events: DataFrame) -> DataFrame:
    last = events.filter("event_type = 'purchase'").groupBy("user_id", _key().alias("k")).agg(F.max("event_id").alias("last"))
    return last.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last")))).filter("r <= 5").drop("r")


@query("events", sql="WITH l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT user_id, last, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'click') AS used FROM events JOIN l USING (user_id) WHERE event_id > last GROUP BY ALL")
def last_edit_then_checks(events: DataFrame) -> DataFrame:
    edit = events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last"))
    later = events.join(edit, "user_id").filter("event_id > last")
    return later.groupBy("user_id", "last").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "click").alias("used"))


@query("events", sql="WITH v AS (SELECT user_id, max(event_id) AS judged FROM events WHERE event_type IN ('click', 'error') GROUP BY 1) SELECT event_id FROM events LEFT JOIN v USING (user_id) WHERE event_type = 'view' AND (judged IS NULL OR event_id > judged)")
def hold_back(events: DataFrame) -> DataFrame:
    """Views that no verdict follows yet."""
    judged = events.filter(F.col("event_type").isin("click", "error")).groupBy("user_id").agg(F.max("event_id").alias("judged")).withColumnRenamed("user_id", "u")
    views = events.filter("event_type = 'view'")
    return views.join(judged, (F.col("user_id") == F.col("u")) & (F.col("event_id") <= F.col("judged")), "left_anti").select("event_id")


@query("events", sql="WITH t AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn_no FROM events), g AS (SELECT user_id, CAST(turn_no AS BIGINT) AS turn_no, bool_or(event_type = 'error') AS e, bool_or(event_type = 'click') AS c FROM t WHERE turn_no > 0 GROUP BY ALL) SELECT user_id, turn_no, CASE WHEN lead(turn_no) OVER (PARTITION BY user_id ORDER BY turn_no) IS NULL THEN 'ended' WHEN e THEN 'contested' WHEN c THEN 'confirmed' ELSE 'silent' END AS verdict FROM g")
def settle_turns(events: DataFrame) -> DataFrame:
    """One verdict for each turn; the last one of a session settles without confirming anything."""
    kind = F.col("event_type")
    turns = session.numbered_turns(events, "user_id", kind == "signup", "ts", "event_id").groupBy("user_id", "turn_no").agg(F.max(kind == "error").alias("e"), F.max(kind == "click").alias("c"))
    ended = F.lead("turn_no").over(W.partitionBy("user_id").orderBy("turn_no")).isNull()
    return turns.select("user_id", "turn_no", F.when(ended, "ended").when(F.col("e"), "contested").when(F.col("c"), "confirmed").otherwise("silent").alias("verdict"))


@query("events", sql="SELECT event_type, count(*) AS n, bool_or(value > 90) AS high, count(DISTINCT user_id) AS users FROM events WHERE event_type IN ('click', 'error', 'signup') GROUP BY 1")
def event_protocol_filter(events: DataFrame) -> DataFrame:
    shared = events.filter(F.col("event_type").isin("click", "error", "signup"))
    return shared.groupBy("event_type").agg(F.count("*").alias("n"), F.bool_or(F.col("value") > 90).alias("high"), F.countDistinct("user_id").alias("users"))


@query("events", sql="WITH a AS (SELECT event_id, date_sub('minute', ts, TIMESTAMP '2024-02-15 00:00:00') AS m FROM events) SELECT event_id, CASE WHEN m < 60 THEN m || ' minutes ago' WHEN m < 2880 THEN m // 60 || ' hours ago' ELSE m // 1440 || ' days ago' END AS age FROM a")
def age_text(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", F.expr("timestampdiff(MINUTE, ts, timestamp_ntz'2024-02-15 00:00:00')").alias("m"))
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return rows.select("event_id", F.when(F.col("m") < 60, ago(F.col("m"), "minutes")).when(F.col("m") < 2880, ago(F.expr("m div 60"), "hours")).otherwise(ago(F.expr("m div 1440"), "days")).alias("age"))


@query("documents", sql="WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(line) AS line_md5, min(pos) AS first, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY doc_id, line HAVING count(*) > 1")
def first_definition(documents: DataFrame) -> DataFrame:
    """Where a line that a document repeats stands first."""
    lines = documents.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter("trim(line) <> ''")
    seen = lines.groupBy("doc_id", F.md5(F.col("line").cast("binary")).alias("line_md5")).agg(F.min("pos").cast("long").alias("first"), F.count("*").alias("n"))
    return seen.filter("n > 1")


@query("documents", sql="SELECT source, round(max(n_chars) FILTER (r = 1) + CAST(0.1 AS DOUBLE) * coalesce(max(n_chars) FILTER (r = 2), 0), 6) AS score FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars IS NOT NULL) WHERE r <= 2 GROUP BY 1")
def zone_best_second(documents: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    two = documents.filter("n_chars is not null").select("source", "n_chars", rank.alias("r")).filter("r <= 2")
    best, second = (F.max(F.when(F.col("r") == i, F.col("n_chars"))) for i in (1, 2))
    return two.groupBy("source").agg(F.round(best + F.lit(0.1).cast("double") * F.coalesce(second, F.lit(0)), 6).alias("score"))


@query("documents", sql="SELECT source, doc_id, lang IN ('en', 'fr') AS shared FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) <= 4")
def family_ceiling(documents: DataFrame) -> DataFrame:
    """Shared and personal items of a zone under one ceiling."""
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), "doc_id"))
    return documents.select("source", "doc_id", F.col("lang").isin("en", "fr").alias("shared"), rank.alias("r")).filter("r <= 4").drop("r")


@query("orders", "customer", sql="SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 3 AND o_orderstatus <> 'F') AND o_orderkey NOT IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)")
def visibility_suspension(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Without what another branch made, unless anchored, and without what the turn under judgement made."""
    elsewhere = customer.filter("c_nationkey = 3").select("c_custkey")
    hidden = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") != "F")
    suspended = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    return orders.join(elsewhere, hidden, "left_anti").join(suspended, "o_orderkey", "left_anti").select("o_orderkey")


@query("orders", "customer", sql="WITH h AS (SELECT o_custkey, max(o_orderdate) AS learned, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY 1) SELECT o_custkey AS id, learned FROM h JOIN customer ON c_custkey = o_custkey WHERE state = 'O' AND c_acctbal > 0")
def anchor_rule(orders: DataFrame, customer: DataFrame) -> DataFrame:
    heads = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("learned"), F.max_by("o_orderstatus", "o_orderkey").alias("state")).filter("state = 'O'")
    clean = customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return heads.join(clean, "o_custkey", "left_semi").select(F.col("o_custkey").alias("id"), "learned")


@query("conversations", "documents", sql="SELECT conv_id, turn, role, source FROM conversations JOIN documents ON doc_id = conv_id")
def citation_role_join(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    return conversations.join(documents.select(F.col("doc_id").alias("conv_id"), "source"), "conv_id").select("conv_id", "turn", "role", "source")


@query("conversations", sql="WITH q AS (SELECT conv_id, turn + 1 AS turn, substr(text, 1, 8) AS quote FROM conversations UNION ALL SELECT conv_id, turn, substr(text, 3, 40) FROM conversations) SELECT q.conv_id, q.turn, quote, length(quote) BETWEEN 6 AND 1200 AND contains(c.text, quote) AS grounded FROM q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn = q.turn WHERE quote IS NOT NULL")
def grounding_check(conversations: DataFrame) -> DataFrame:
    """Whether a quote stands in the event it cites: here those of the event itself and of the one before."""
    own = conversations.select("conv_id", "turn", F.substring("text", 3, 40).alias("quote"))
    quotes = conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.substring("text", 1, 8).alias("quote")).unionByName(own).filter("quote is not null")
    events = conversations.select("conv_id", "turn", "text")
    return quotes.join(events, ["conv_id", "turn"]).select("conv_id", "turn", "quote", (F.length("quote").between(6, 1200) & F.col("text").contains(F.col("quote"))).alias("grounded"))


@query("conversations", sql="WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, regexp_extract(text, '^[^.]*', 0) AS said FROM c WHERE role = 'user' AND before = 'assistant' AND length(regexp_extract(text, '^[^.]*', 0)) >= 6")
def explanation_capture(conversations: DataFrame) -> DataFrame:
    """The first sentence of what a user answers becomes a constraint, if it says something."""
    said = F.regexp_extract("text", "^[^.]*", 0)
    rows = conversations.withColumn("before", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    return rows.filter("role = 'user' and before = 'assistant'").select("conv_id", "turn", said.alias("said")).filter("length(said) >= 6")
