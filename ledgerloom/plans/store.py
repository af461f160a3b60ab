"""Queries on what a store keeps: proofs of lessons, what phrases mean, verdicts, delivery, pushes, quotes, versions of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, history, validation
from ..streaming import sinks
from ..workload import query


@query(
    "events",
    sql="WITH e AS (SELECT event_id, user_id, event_type FROM events), l AS (SELECT 'l' || event_id AS id, event_id, user_id, event_id % 5 = 0 AS blank, CASE WHEN event_id % 7 = 0 THEN 'other' WHEN event_id % 5 = 0 THEN ' ' ELSE 'done' END AS content, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'done' END AS last FROM e WHERE event_type = 'purchase'), "
    "q AS (SELECT l.id, l.user_id, e.user_id AS of, blank FROM l LEFT JOIN e ON e.event_id = l.event_id + 1) "
    "SELECT DISTINCT id, 'quote' AS problem FROM q WHERE blank OR of IS DISTINCT FROM user_id UNION ALL SELECT id, 'content' FROM l WHERE content <> last UNION ALL SELECT id, 'resolution' FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.event_id = l.event_id + 2 AND event_type = 'error')",
)
def lesson_proofs(events: DataFrame) -> DataFrame:
    """Lessons of purchases, proven by the event itself and the next one: quotes that are blank or of another session, contents that differ, errors that weren't seen."""
    last = F.when(F.col("event_id") % 5 == 0, F.lit(" ")).otherwise(F.lit("done"))
    key = F.col("event_id")
    proofs = F.array(*(F.struct((key + i).cast("string").alias("event_id"), said.alias("quote")) for i, said in ((0, F.lit("ok")), (1, last))))
    lessons = events.filter("event_type = 'purchase'").select(F.concat(F.lit("l"), key.cast("string")).alias("id"), F.col("user_id").cast("string").alias("session_id"), F.array(key.cast("string"), (key + 1).cast("string")).alias("event_ids"), F.when(key % 7 == 0, F.lit("other")).otherwise(last).alias("content"), proofs.alias("proofs"), (key + 2).cast("string").alias("error_event_id"))
    told = events.select(key.cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_type") == "error", "error_observed").otherwise("observation").alias("kind"))
    return validation.unproven_lessons(lessons, told)


_VERSIONS = "v AS (SELECT 'version:' || sha256(CAST(doc_id AS VARCHAR)) AS id, 'k' || doc_id // 4 AS knowledge_id, doc_id % 4 + 1 AS version, coalesce(text, '') AS content FROM documents WHERE doc_id % 10 <> 9)"


def _versions(documents: DataFrame) -> DataFrame:
    """Four documents are the versions of one knowledge; those of the last tenth are recorded too late."""
    return documents.select(F.concat(F.lit("version:"), F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)).alias("id"), F.concat(F.lit("k"), F.expr("cast(doc_id div 4 as string)")).alias("knowledge_id"), (F.col("doc_id") % 4 + 1).alias("version"), F.coalesce("text", F.lit("")).alias("content"), F.array().cast("array<string>").alias("zones"), F.when(F.col("doc_id") % 10 == 9, F.lit("2026-02-02T00:00:00Z")).otherwise(F.lit("2026-01-01T00:00:00Z")).alias("recorded_at"))


@query("documents", sql=f"WITH {_VERSIONS}, h AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY knowledge_id ORDER BY version DESC) = 1) SELECT id, knowledge_id, CAST(version AS BIGINT) AS version FROM h WHERE list_has_all(regexp_extract_all(lower(strip_accents(knowledge_id || ' ' || content)), '[\\p{{L}}\\p{{N}}_]+'), ['ther', 'tion'])".replace("\\\\", "\\"))
def knowledge_resolution(documents: DataFrame) -> DataFrame:
    """What a phrase means that is neither an id nor a reference: the newest versions, at a time, that hold all its words."""
    return history.resolved(_versions(documents), "ther tion", "2026-02-01T00:00:00Z").select("id", "knowledge_id", "version")


@query("documents", sql=f"WITH {_VERSIONS} SELECT id, knowledge_id, CAST(version AS BIGINT) AS version FROM v WHERE knowledge_id = 'k7' ORDER BY version DESC LIMIT 1")
def knowledge_by_name(documents: DataFrame) -> DataFrame:
    """A name that is a knowledge's own means its newest version at a time."""
    return history.resolved(_versions(documents), "k7", "2026-02-01T00:00:00Z").select("id", "knowledge_id", "version")


@query("orders", "customer", sql="SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN 'proposed' WHEN c_custkey % 3 = 0 THEN 'contested' ELSE 'active' END AS state FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 3) ON c_custkey = o_custkey WHERE c_custkey IS NULL OR c_custkey % 3 <> 1")
def states_after_verdicts(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """What is learnt from a turn after its verdict follows it: contested, kept back, active; without a verdict it waits."""
    turn = F.col("c_custkey")
    verdicts = customer.filter(turn % 4 != 3).select(turn.alias("turn"), F.when(turn % 3 == 0, "correction").when(turn % 3 == 1, "withheld").otherwise("no_correction").alias("verdict"))
    return history.born(orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("turn")), verdicts)


@query(
    "conversations",
    sql=f"WITH i AS (SELECT DISTINCT conv_id AS session, 'memory:' || turn AS key, turn FROM conversations), l AS (SELECT session, key, turn AS pos FROM i WHERE turn % 2 = 0), g AS (SELECT session, key FROM l WHERE turn_of(key) % 5 = 4), a AS (SELECT session, key, 0 AS late, pos FROM l WHERE turn_of(key) % 5 <> 4 UNION ALL SELECT session, key, 1, 0 FROM i WHERE turn % 2 = 1), n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY late DESC, pos DESC, key DESC) AS newest FROM a QUALIFY newest <= {context.LEDGER}) SELECT session, key, row_number() OVER (PARTITION BY session ORDER BY newest DESC) AS pos FROM n".replace("turn_of(key)", "CAST(substr(key, 8) AS BIGINT)"),
)
def ledger_after_delivery(conversations: DataFrame) -> DataFrame:
    """What a session has been given once new items are delivered and those of memories that are valid no more are withdrawn."""
    items = conversations.select(F.col("conv_id").alias("session"), F.concat(F.lit("memory:"), F.col("turn").cast("string")).alias("key"), "turn").distinct()
    ledger = items.filter("turn % 2 = 0").select("session", "key", F.col("turn").alias("pos"))
    return context.delivered(items.select("session", "key"), ledger, items.filter("turn % 5 <> 4").select("key").distinct())[2]


@query("orders", sql="SELECT count(*) AS operations, true AS fits, true AS ordered FROM orders WHERE o_orderkey % 6 <> 0")
def push_chunks(orders: DataFrame) -> DataFrame:
    """Operations that were not sent yet go in pushes of at most 100, and no push begins before the one before it ends."""
    operations = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"))
    pushes = sinks.chunks(operations, operations.filter("id % 6 = 0")).groupBy("push").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    # Two pushes are in order if their numbers are: each is compared with the one that begins next.
    pairs = pushes.select("push", "high").join(pushes.select(F.col("push").alias("other"), "low"), F.col("other") == F.col("push") + 1).agg(F.coalesce(F.bool_and(F.col("high") < F.col("low")), F.lit(True)).alias("ordered"))
    return pushes.agg(F.sum("n").alias("operations"), (F.max("n") <= sinks.CHUNK).alias("fits")).crossJoin(F.broadcast(pairs))


@query(
    "documents",
    "labels",
    sql="WITH s AS (SELECT doc_id, text FROM documents), q AS (SELECT doc_id AS key, doc_id AS source_id, CASE WHEN doc_id % 6 = 0 THEN 'not there at all ' || doc_id ELSE substr(text, 1, CAST(20 + doc_id % 3 AS INT)) END AS quote FROM s WHERE text IS NOT NULL), k AS (SELECT l.doc_id AS key, substr(text, 1, CAST(20 + l.doc_id % 3 AS INT)) AS content FROM labels l JOIN s USING (doc_id) WHERE l.quality = 1 AND text IS NOT NULL), "
    "n AS (SELECT q.*, lower(regexp_replace(trim(regexp_replace(quote, '\\s+', ' ', 'g')), '[.!;:, ]+$', '')) AS said FROM q JOIN s ON s.doc_id = source_id WHERE contains(text, quote) AND length(quote) BETWEEN 1 AND 1200 AND key NOT IN (SELECT key FROM k)), o AS (SELECT DISTINCT lower(regexp_replace(trim(regexp_replace(content, '\\s+', ' ', 'g')), '[.!;:, ]+$', '')) AS said FROM k) "
    "SELECT key, source_id, quote FROM n WHERE said NOT IN (SELECT said FROM o) QUALIFY row_number() OVER (PARTITION BY said ORDER BY key) = 1".replace("\\\\", "\\"),
)
def remembered_quotes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Quotes to keep: held by their source, under a new key, and not known in another spelling; one of those that say the same."""
    rows = documents.filter("text is not null")
    cut = F.substring(F.col("text"), F.lit(1), (20 + F.col("doc_id") % 3).cast("int"))
    quotes = rows.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("not there at all "), F.col("doc_id").cast("string"))).otherwise(cut).alias("quote"))
    stored = rows.join(labels.filter("quality = 1").select("doc_id"), "doc_id").select(F.col("doc_id").alias("key"), cut.alias("content"))
    return validation.remembered(quotes, rows.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), stored)
