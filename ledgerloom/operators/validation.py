"""Checks of knowledge records: records(sources, events, versions, relations) -> problems(record, id, problem)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

# Kinds, states and lengths that records may have.
SOURCE_KINDS = ["conversation", "commit", "pull_request", "document", "legacy_pattern"]
KNOWLEDGE_KINDS = ["convention", "decision", "constraint", "fact", "procedure", "incident", "counterexample", "rejected_alternative", "open_question", "legacy_pattern", "lesson"]
EVENT_KINDS = ["instruction", "proposal", "acceptance", "action_attempted", "outcome_verified", "observation", "error_observed", "legacy_import"]
RELATION_KINDS = ["applies_to", "motivated_by", "supported_by", "contradicts", "supersedes", "exception_to", "alternative_to", "read_with"]
STATES = ["proposed", "active", "contested", "superseded", "archived"]
QUOTE, REMEMBERED = 600, 1200


def as_fields(schema: str) -> str:
    """Columns of a table as fields of a struct."""
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            word = ""
        else:
            word += c
    return ",".join(out)


def _said(name: str):
    return F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) > 0


def _found(rows: DataFrame, record: str, problem: str, wrong) -> DataFrame:
    return rows.filter(wrong).select(F.lit(record).alias("record"), F.col("id").cast("string").alias("id"), F.lit(problem).alias("problem"))


def _missing(rows: DataFrame, record: str, column: str, among: DataFrame, problem: str) -> DataFrame:
    """Rows one of whose ids is not among others."""
    gone = rows.select("id", F.explode(column).alias("ref")).join(among.select(F.col("id").alias("ref")), "ref", "left_anti")
    return gone.select(F.lit(record).alias("record"), "id", F.lit(problem).alias("problem")).distinct()


def _dangling(relations: DataFrame, side: str, records: dict[str, DataFrame]) -> DataFrame:
    ref = relations.select("id", F.col(side)["type"].alias("type"), F.col(side)["id"].alias("ref"))
    there = reduce(DataFrame.unionByName, [records[t].select(F.lit(k).alias("type"), F.col("id").alias("ref")) for k, t in (("source", "sources"), ("event", "events"), ("version", "versions"))])
    return ref.filter("type <> 'code' or type is null").join(there, ["type", "ref"], "left_anti").select(F.lit("relations").alias("record"), "id", F.lit("dangling relation").alias("problem"))


def problems(records: dict[str, DataFrame]) -> DataFrame:
    """Everything that is wrong with records that refer to each other; no rows if nothing is."""
    sources, events, versions, relations = (records[n] for n in ("sources", "events", "versions", "relations"))
    out = []
    for name, rows in records.items():
        out.append(_found(rows, name, "id or date", ~(_said("id") & text.is_instant(F.col("recorded_at")))))
        out.append(rows.groupBy("id").count().filter("count > 1").select(F.lit(name).alias("record"), "id", F.lit("duplicate id").alias("problem")))
    out.append(_found(sources, "sources", "kind or reference", ~(F.coalesce(F.col("kind").isin(SOURCE_KINDS), F.lit(False)) & _said("reference"))))
    out.append(_found(events, "events", "kind or content", ~(F.coalesce(F.col("kind").isin(EVENT_KINDS), F.lit(False)) & _said("content"))))
    known = F.coalesce(F.col("kind").isin(KNOWLEDGE_KINDS) & F.col("state").isin(STATES), F.lit(False))
    out.append(_found(versions, "versions", "kind, state or content", ~(known & _said("knowledge_id") & _said("content"))))
    out.append(_found(relations, "relations", "kind", ~F.coalesce(F.col("kind").isin(RELATION_KINDS), F.lit(False))))
    for name, rows in (("versions", versions), ("relations", relations)):
        out.append(_found(rows, name, "validity interval", F.coalesce(F.try_to_timestamp("valid_from") > F.try_to_timestamp("valid_until"), F.lit(False))))
    for name, rows in (("events", events), ("versions", versions), ("relations", relations)):
        out.append(_found(rows, name, "no sources", F.coalesce(F.size("source_ids"), F.lit(0)) <= 0))
        out.append(_missing(rows, name, "source_ids", sources, "unknown source"))
    out.append(_missing(versions, "versions", "event_ids", events, "unknown event"))
    before = W.partitionBy("knowledge_id").orderBy("version")
    chain = versions.withColumns({"n": F.coalesce(F.lag("version").over(before), F.lit(0)), "p": F.lag("id").over(before)})
    out.append(_found(chain, "versions", "version chain", (F.col("version") != F.col("n") + 1) | ~F.col("previous_version_id").eqNullSafe(F.col("p"))))
    out += [_dangling(relations, side, records) for side in ("from", "to")]
    return reduce(DataFrame.unionByName, out).distinct()


def unproven_lessons(lessons: DataFrame, events: DataFrame) -> DataFrame:
    """lessons(id, session_id, event_ids, content, proofs array<struct<event_id, quote>>, error_event_id) -> id, problem: quotes that are
    empty, too long or from events of another session, and lessons that don't say what their last proof says."""
    proofs = lessons.select("id", "session_id", "event_ids", F.explode("proofs").alias("p")).select("id", "session_id", "event_ids", "p.*")
    told = events.select(F.col("id").alias("event_id"), F.col("session_id").alias("of"), "kind")
    seen = proofs.join(told, "event_id", "left")
    good = (F.length(F.trim("quote")) > 0) & (F.length("quote") <= QUOTE) & F.array_contains("event_ids", F.col("event_id")) & (F.col("of") == F.col("session_id"))
    quotes = seen.filter(~F.coalesce(good, F.lit(False))).select("id", F.lit("quote").alias("problem"))
    content = lessons.filter(F.col("content") != F.element_at("proofs", -1)["quote"]).select("id", F.lit("content").alias("problem"))
    errors = lessons.join(events.filter("kind = 'error_observed'").select(F.col("id").alias("error_event_id")), "error_event_id", "left_anti").select("id", F.lit("resolution").alias("problem"))
    return quotes.union(content).union(errors).distinct()


def recorded_traces(traces: DataFrame, events: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """traces(key, event_id, quote, parent), events(id, content), known(key, fingerprint) -> those to add, with a fingerprint, and those that are
    wrong (key, problem): a quote that its event doesn't hold, an unknown event or parent, a key that stands for something else."""
    mark = F.sha2(F.to_json(F.struct("event_id", "quote", "parent")).cast("binary"), 256)
    rows = traces.withColumn("fingerprint", mark).join(events.select(F.col("id").alias("event_id"), F.col("content").alias("said")), "event_id", "left")
    rows = rows.join(known.select("key", F.col("fingerprint").alias("old")), "key", "left")
    parents = traces.select(F.col("key").alias("parent")).union(known.select("key")).distinct().withColumn("there", F.lit(True))
    rows = rows.join(parents, "parent", "left")
    problem = F.when(F.col("said").isNull(), "unknown event").when(~F.contains("said", "quote"), "quote").when(F.col("parent").isNotNull() & F.col("there").isNull(), "unknown parent").when(F.col("old") != F.col("fingerprint"), "key in use")
    rows = rows.withColumn("problem", problem)
    return rows.filter("problem is null and old is null").select("key", "event_id", "quote", "parent", "fingerprint"), rows.filter("problem is not null").select("key", "problem")


def remembered(quotes: DataFrame, sources: DataFrame, stored: DataFrame) -> DataFrame:
    """quotes(key, source_id, quote), sources(id, content), stored(key, content) -> key, source_id, quote to store: held by their source, not too long,
    under a new key, and not known already in other spelling."""
    held = quotes.join(sources.select(F.col("id").alias("source_id"), "content"), "source_id").filter(F.contains("content", "quote") & F.length("quote").between(1, REMEMBERED))
    new = held.join(stored.select("key"), "key", "left_anti").withColumn("said", text.normalised(F.col("quote")))
    new = new.join(stored.select(text.normalised(F.col("content")).alias("said")), "said", "left_anti")
    return new.groupBy("said").agg(F.min_by(F.struct("key", "source_id", "quote"), "key").alias("q")).select("q.*")
