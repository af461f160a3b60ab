"""Links of new rules to those close to them, what they replace, and the way back.

Only rules recorded since a time are examined, the first NEW_RULES of them in a run, each against the CANDIDATES closest to it. Ids follow from what is linked,
so a run that comes again adds nothing. A rule that is replaced gets a new version that says so, unless it has changed since; when the replacement
was wrong, another version makes it active again. History keeps all versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..providers import CANDIDATES, NEW_RULES, Registry
from .closest import closest


def heads(versions: DataFrame) -> DataFrame:
    """The newest version of each knowledge."""
    newest = versions.groupBy("knowledge_id").agg(F.max("version").alias("version"))
    return versions.join(newest, ["knowledge_id", "version"]).select(*versions.columns)


def _digest(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws(":", *parts).cast("binary"), 256))


def candidates(versions: DataFrame, vectors: DataFrame, since: str) -> DataFrame:
    """versions, vectors(knowledge_id, vec) -> a, a_content, b, b_content, near: new rules and those closest to them, and their closeness."""
    rules = heads(versions).filter("state = 'active'").join(vectors.select("knowledge_id", "vec"), "knowledge_id", "left")
    rules = rules.select(F.xxhash64("id").alias("idx"), "id", "content", "recorded_at", F.col("vec").cast("array<double>").alias("vector"), text.part_words(F.col("content")).alias("tokens"))
    fresh = rules.filter(F.col("recorded_at") >= since).orderBy("recorded_at", "id").limit(NEW_RULES)
    near = closest(rules, fresh.select("idx"), CANDIDATES)
    side = lambda c: rules.select(F.col("idx").alias(f"{c}_idx"), F.col("id").alias(c), F.col("content").alias(f"{c}_content"), F.col("vector").alias(f"{c}_vector"))
    pairs = near.withColumnsRenamed({"asked": "a_idx", "idx": "b_idx"}).join(side("a"), "a_idx").join(side("b"), "b_idx")
    dot = F.aggregate(F.zip_with("a_vector", "b_vector", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("a", "a_content", "b", "b_content", F.coalesce(dot, F.lit(0.0)).alias("near"))


def linked(pairs: DataFrame, versions: DataFrame, relations: DataFrame, now: str, decide: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """candidates(), versions, relations -> new relations and new versions, none that are there already."""
    decide = decide or Registry()["link"]
    found = decide(pairs).select("a", "b", "kind").distinct()
    ref = lambda c: F.struct(F.lit("version").alias("type"), F.col(c).alias("id"))
    own = F.when(F.col("kind") == "read_with", F.concat_ws(":", "a", "b")).otherwise(F.concat_ws(":", "kind", "a", "b"))
    rows = found.join(versions.select(F.col("id").alias("a"), "source_ids"), "a")
    nothing = F.lit(None).cast("string")
    new = rows.select(_digest("link:", own).alias("id"), "kind", ref("a").alias("from"), ref("b").alias("to"), "source_ids", F.lit(now).alias("recorded_at"), nothing.alias("valid_from"), nothing.alias("valid_until"))
    new = new.join(relations.select("id"), "id", "left_anti")
    replaced = found.filter("kind = 'supersedes'").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("by"))
    over = heads(versions).filter("state = 'active'").join(replaced, "id")  # what has changed since is no head under that id
    return new, _next(over, versions.columns, "superseded", F.concat_ws(":", "id", F.lit("superseded"), "by"), now)


def _next(rows: DataFrame, columns: list[str], state: str, key: Column, now: str) -> DataFrame:
    """The version that follows each row, in another state."""
    put = {"id": _digest("version:", key), "previous_version_id": F.col("id"), "version": F.col("version") + 1, "state": F.lit(state), "recorded_at": F.lit(now)}
    return rows.select(*(put.get(c, F.col(c)).alias(c) for c in columns))


def replaced_rules(versions: DataFrame, relations: DataFrame) -> DataFrame:
    """Rules that a newer one replaced, by `supersedes`; newest first."""
    over = relations.filter("kind = 'supersedes'").select(F.col("to.id").alias("id")).join(versions.select("id", "knowledge_id"), "id").select("knowledge_id").distinct()
    return heads(versions).filter("state = 'superseded'").join(over, "knowledge_id", "left_semi").orderBy(F.desc("recorded_at"), "id")


def reactivated(versions: DataFrame, relations: DataFrame, which: str, now: str) -> DataFrame:
    """The version that makes a replaced rule active again; `which` begins its id or its knowledge's, of one rule only."""
    rows = replaced_rules(versions, relations).filter(F.startswith("id", F.lit(which)) | F.startswith("knowledge_id", F.lit(which)))
    count = rows.limit(2).count()
    if count != 1:
        raise ValueError(f"{which}: {'several replaced rules begin so' if count else 'no replaced rule'}")
    return _next(rows, versions.columns, "active", F.concat_ws(":", "id", F.lit("reactivated"), F.lit(now)), now)
