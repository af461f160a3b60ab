"""Why a version is as it is: from versions, relations, events and sources as sources.knowledge reads them, at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Steps of a chain of reasons and reasons shown; rounds of an investigation, its candidates and the relations it follows.
DEPTH, REASONS, ROUNDS, CANDIDATES, RELEVANCE = 6, 100, 3, 12, 0.3
FOLLOWED = ["motivated_by", "contradicts", "exception_to", "supersedes"]
REASON = "relation string, from_id string, to_id string, level int, cycle boolean"


def recorded(rows: DataFrame, at: str) -> DataFrame:
    return rows.filter(F.to_timestamp("recorded_at") <= F.to_timestamp(F.lit(at)))


def in_force(at: str):
    """From a beginning, which counts, to an end, which doesn't; where one is missing there is no bound."""
    now = F.to_timestamp(F.lit(at))
    return F.coalesce(F.to_timestamp("valid_from") <= now, F.lit(True)) & F.coalesce(now < F.to_timestamp("valid_until"), F.lit(True))


def heads(versions: DataFrame, at: str) -> DataFrame:
    """The newest version of each knowledge at a time."""
    names = versions.columns
    return recorded(versions, at).groupBy("knowledge_id").agg(F.max_by(F.struct(*names), "version").alias("h")).select("h.*")


def resolved(versions: DataFrame, query: str, at: str) -> DataFrame:
    """Versions that a phrase means: that id, else that short reference, else the newest of that knowledge, else the newest ones that hold all its
    words. The first rule with an answer decides."""
    known, newest = recorded(versions, at), heads(versions, at)
    words = known.sparkSession.createDataFrame([(query,)], "q string").select(text.question_words(F.col("q")).alias("w")).first().w
    held = text.history_words(F.concat_ws(" ", "knowledge_id", "content", F.array_join("zones", " ")))
    all_words = F.size(F.array_except(F.array(*map(F.lit, words)), held)) == 0 if words else F.lit(False)
    rules = [known.filter(F.col("id") == query), known.filter((text.short_reference(F.col("id")) == query) & (F.col("id") != query)), newest.filter(F.col("knowledge_id") == query), newest.filter(all_words)]
    tried = None
    for k, rows in enumerate(rules):
        rows = rows.withColumn("rule", F.lit(k))
        tried = rows if tried is None else tried.unionByName(rows)
    return tried.join(tried.agg(F.min("rule").alias("rule")), "rule").drop("rule")


def visible(relations: DataFrame, versions: DataFrame, events: DataFrame, sources: DataFrame, at: str) -> DataFrame:
    """Relations that are recorded and in force at a time, both of whose ends and all of whose sources are recorded by then."""
    known = [recorded(t, at).select(F.lit(k).alias("type"), "id") for k, t in (("version", versions), ("event", events), ("source", sources))]
    known = known[0].union(known[1]).union(known[2])
    rows = recorded(relations, at).filter(in_force(at))
    for side in ("from", "to"):
        there = known.select(F.struct("type", "id").alias("ref")).withColumn("there", F.lit(True))
        rows = rows.withColumn("ref", F.struct(F.col(side)["type"].alias("type"), F.col(side)["id"].alias("id"))).join(there, "ref", "left")
        rows = rows.filter(F.col("there") | (F.col("ref.type") == "code")).drop("ref", "there")
    gone = rows.select("id", F.explode("source_ids").alias("s")).join(recorded(sources, at).select(F.col("id").alias("s")), "s", "left_anti")
    return rows.join(gone.select("id"), "id", "left_anti")


def between_versions(relations: DataFrame) -> DataFrame:
    """relation, kind, src, dst of relations from one version to another."""
    return relations.filter("from.type = 'version' and to.type = 'version'").select(F.col("id").alias("relation"), "kind", F.col("from.id").alias("src"), F.col("to.id").alias("dst"))


def why(relations: DataFrame, version: str, depth: int = DEPTH) -> tuple[DataFrame, bool]:
    """Visible relations -> reasons (relation, from_id, to_id, level, cycle) behind a version and whether some were left out.

    Each version is looked into once, at its least level. Levels and reasons are bounded, so the driver walks."""
    if not 1 <= depth <= 20:
        raise ValueError("a depth of 1 to 20 is supported")
    spark, edges = relations.sparkSession, between_versions(relations).filter("kind = 'motivated_by'")
    paths, front, out, cut = {version: (version,)}, [version], [], False
    for level in range(depth + 1):
        if not front:
            break
        rows = edges.filter(F.col("src").isin(front)).orderBy("src", "relation").limit(REASONS + 1).collect()
        if level == depth:
            cut |= bool(rows)
            break
        front = []
        for r in rows:
            if len(out) == REASONS:
                cut = True
                break
            out.append((r.relation, r.src, r.dst, level + 1, r.dst in paths[r.src]))
            if r.dst not in paths:
                paths[r.dst] = (*paths[r.src], r.dst)
                front.append(r.dst)
    return spark.createDataFrame(out, REASON), cut


def around(relations: DataFrame, version: str) -> DataFrame:
    """relation, part, other: what supports a version, speaks against it, could stand for it or replaces it."""
    part = F.when(F.col("kind") == "supported_by", "evidence").when(F.col("kind").isin("contradicts", "exception_to"), "counterexample").when(F.col("kind") == "alternative_to", "alternative").when(F.col("kind") == "supersedes", "replacement")
    own = (F.col("from.type") == "version") & (F.col("from.id") == version)
    rows = relations.filter(own | ((F.col("to.type") == "version") & (F.col("to.id") == version)))
    return rows.select(F.col("id").alias("relation"), part.alias("part"), F.when(own, F.col("to.id")).otherwise(F.col("from.id")).alias("other")).filter("part is not null")


def history(versions: DataFrame, relations: DataFrame, events: DataFrame, sources: DataFrame, knowledge: str, at: str) -> dict[str, DataFrame]:
    """All versions of one knowledge by a time, with the relations, events and sources that belong to them."""
    own = recorded(versions, at).filter(F.col("knowledge_id") == knowledge)
    ids = own.select("id")
    near = recorded(relations, at)
    ends = [near.select(F.col("id").alias("relation"), F.col(f"{s}.type").alias("type"), F.col(f"{s}.id").alias("id")) for s in ("from", "to")]
    ends = ends[0].union(ends[1])
    near = near.join(ends.filter("type = 'version'").join(ids, "id", "left_semi").select(F.col("relation").alias("id")).distinct(), "id", "left_semi")
    ends = ends.join(near.select(F.col("id").alias("relation")), "relation", "left_semi")
    told = recorded(events, at).join(own.select(F.explode("event_ids").alias("id")).union(ends.filter("type = 'event'").select("id")).distinct(), "id", "left_semi")
    said = own.select(F.explode("source_ids").alias("id")).union(near.select(F.explode("source_ids"))).union(told.select(F.explode("source_ids"))).union(ends.filter("type = 'source'").select("id"))
    return {"versions": own, "relations": near, "events": told, "sources": recorded(sources, at).join(said.distinct(), "id", "left_semi")}


def investigated(relations: DataFrame, found: DataFrame, relevance: DataFrame) -> DataFrame:
    """found(id), relevance(id, score) -> id, round: what is related in either direction, a few rounds far, if it is relevant enough; the most
    relevant ones first, CANDIDATES in all."""
    links = between_versions(relations).filter(F.col("kind").isin(FOLLOWED))
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = {r.id: 0 for r in found.join(relevance, "id", "left").orderBy(F.desc("score"), "id").limit(CANDIDATES).collect()}
    front = list(seen)
    for k in range(1, ROUNDS + 1):
        room = CANDIDATES - len(seen)
        if not front or not room:
            break
        near = both.filter(F.col("src").isin(front) & ~F.col("dst").isin(list(seen))).select(F.col("dst").alias("id")).distinct()
        rows = near.join(relevance, "id").filter(F.col("score") >= RELEVANCE).orderBy(F.desc("score"), "id").limit(room).collect()
        front = [r.id for r in rows]
        seen |= dict.fromkeys(front, k)
    return relations.sparkSession.createDataFrame(list(seen.items()), "id string, round int")


def neighbourhood(versions: DataFrame, relations: DataFrame, events: DataFrame, version: str) -> dict[str, DataFrame]:
    """A version, all versions of the knowledge it is related to, and their events: what an evaluation looks at."""
    links = between_versions(relations).filter((F.col("src") == version) | (F.col("dst") == version))
    ids = links.select("src").union(links.select("dst")).toDF("id").union(versions.sparkSession.createDataFrame([(version,)], "id string")).distinct()
    families = versions.join(ids, "id", "left_semi").select("knowledge_id").distinct()
    own = versions.join(families, "knowledge_id", "left_semi")
    return {"versions": own, "relations": relations.join(links.select(F.col("relation").alias("id")), "id", "left_semi"), "events": events.join(own.select(F.explode("event_ids").alias("id")).distinct(), "id", "left_semi")}


def adopted(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming(seq, id, knowledge_id, state, content, zones) of others -> versions to add: known ids are skipped, and what is equal to
    what stands before it; else the next version of its knowledge. What stands before is the record before it, as one that is skipped is equal to it."""
    from pyspark.sql import Window as W

    own = versions.groupBy("knowledge_id").agg(F.max_by(F.struct("id", "state", "content", "zones", "version"), "version").alias("head"))
    order = W.partitionBy("knowledge_id").orderBy("seq", "id")
    new = incoming.dropDuplicates(["id"]).join(versions.select("id"), "id", "left_anti").join(own, "knowledge_id", "left")
    now = F.struct("state", "content", "zones")
    before = F.coalesce(F.lag(now).over(order), F.when(F.col("head").isNotNull(), F.struct("head.state", "head.content", "head.zones")))
    new = new.withColumn("now", now).withColumn("before", before).filter(F.col("before").isNull() | (F.col("now") != F.col("before")))
    step = F.row_number().over(order)
    return new.select("id", "knowledge_id", (F.coalesce("head.version", F.lit(0)) + step).cast("long").alias("version"), F.coalesce(F.lag("id").over(order), "head.id").alias("previous_version_id"), "state", "content", "zones")


def applied(items: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items(knowledge_id, kind, content, event_id) learnt from events -> versions to add and the relations that prove them. An item that
    says what the newest version says adds nothing."""
    newest = versions.groupBy("knowledge_id").agg(F.max_by(F.struct("id", "version", "content"), "version").alias("h"))
    rows = items.groupBy("knowledge_id").agg(F.max_by(F.struct("kind", "content", "event_id"), "event_id").alias("i")).select("knowledge_id", "i.*")
    rows = rows.join(newest, "knowledge_id", "left").filter(F.col("h").isNull() | (text.normalised(F.col("h.content")) != text.normalised(F.col("content"))))
    number = (F.coalesce("h.version", F.lit(0)) + 1).cast("long")
    key = F.concat(F.lit("version:"), F.sha2(F.to_json(F.array("knowledge_id", "content", number.cast("string"))).cast("binary"), 256))
    new = rows.select(key.alias("id"), "knowledge_id", number.alias("version"), F.col("h.id").alias("previous_version_id"), "kind", "content", F.array("event_id").alias("event_ids"))
    proofs = new.select(F.concat(F.lit("relation:"), F.substring("id", 9, 64)).alias("id"), F.lit("supported_by").alias("kind"), F.struct(F.lit("version").alias("type"), F.col("id").alias("id")).alias("from"), F.struct(F.lit("event").alias("type"), F.element_at("event_ids", 1).alias("id")).alias("to"))
    return new, proofs


def born(extracted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """extracted(id, turn), verdicts(turn, verdict) -> id, state: what is learnt from a turn after its verdict follows it: contested after a correction,
    nothing from a withheld one, active else; without a verdict it waits."""
    state = F.when(F.col("verdict") == "correction", "contested").when(F.col("verdict") == "withheld", F.lit(None)).when(F.col("verdict").isNull(), "proposed").otherwise("active")
    rows = extracted.join(verdicts, "turn", "left").select("id", state.alias("state"))
    return rows.filter("state is not null")
