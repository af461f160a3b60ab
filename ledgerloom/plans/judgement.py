"""Queries on what turns used and what came of it: sessions are users; a signup opens a turn, views are what it was given,
purchases its edits, errors corrections; the number in props names an item, its tens a zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import retrieval, session
from ..workload import query

_T = "t AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events), s AS (SELECT user_id, CAST(turn AS BIGINT) AS turn, bool_or(event_type = 'error') AS corrected, turn < max(turn) OVER (PARTITION BY user_id) AS closed FROM t WHERE turn > 0 GROUP BY user_id, t.turn)"


def _turns(events: DataFrame) -> DataFrame:
    """Events after the first opening of a session, with turn, item and zone."""
    rows = session.numbered_turns(events, "user_id", F.col("event_type") == "signup", "ts", "event_id").withColumnRenamed("turn_no", "turn")
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.select("user_id", F.col("turn").cast("long").alias("turn"), "event_id", "ts", "event_type", k.alias("k"), F.floor(k / 10).alias("zone"))


def _judged(turns: DataFrame) -> DataFrame:
    """user_id, turn, corrected of the turns that another one follows."""
    each = turns.groupBy("user_id", "turn").agg(F.bool_or(F.col("event_type") == "error").alias("corrected"))
    return each.withColumn("last", F.max("turn").over(W.partitionBy("user_id"))).filter("turn < last").drop("last")


@query("events", sql=f"WITH {_T} SELECT DISTINCT v.user_id, CAST(v.turn AS BIGINT) AS turn, v.k FROM t v JOIN s ON s.user_id = v.user_id AND s.turn = v.turn AND s.closed AND NOT s.corrected WHERE v.event_type = 'view' AND EXISTS (SELECT 1 FROM t e WHERE e.user_id = v.user_id AND e.turn = v.turn AND e.event_type = 'purchase' AND e.k // 10 = v.k // 10)")
def confirmations(events: DataFrame) -> DataFrame:
    """Items that a turn was given and that an edit of their zone used, if the next message didn't correct the turn; each once."""
    turns = _turns(events)
    edits = turns.filter("event_type = 'purchase'").select("user_id", "turn", "zone")
    good = _judged(turns).filter("not corrected").select("user_id", "turn")
    given = turns.filter("event_type = 'view'").select("user_id", "turn", "k", "zone")
    return given.join(good, ["user_id", "turn"], "left_semi").join(edits, ["user_id", "turn", "zone"], "left_semi").select("user_id", "turn", "k").distinct()


@query("events", sql=f"WITH {_T}, c AS (SELECT DISTINCT v.user_id, CAST(v.turn AS BIGINT) AS turn, v.k FROM t v JOIN s ON s.user_id = v.user_id AND s.turn = v.turn AND s.closed AND s.corrected WHERE v.event_type = 'view') SELECT user_id, k, turn, 1 + row_number() OVER (PARTITION BY user_id, k ORDER BY turn) AS version, 'contested' AS state FROM c")
def contested_versions(events: DataFrame) -> DataFrame:
    """What a corrected turn was given gets a further version, contested."""
    turns = _turns(events)
    bad = _judged(turns).filter("corrected").select("user_id", "turn")
    given = turns.filter("event_type = 'view'").select("user_id", "turn", "k").distinct().join(bad, ["user_id", "turn"], "left_semi")
    version = 1 + F.row_number().over(W.partitionBy("user_id", "k").orderBy("turn"))
    return given.select("user_id", "k", "turn", version.cast("long").alias("version"), F.lit("contested").alias("state"))


@query("events", sql=f"WITH {_T}, e AS (SELECT t.* FROM t JOIN s ON s.user_id = t.user_id AND s.turn = t.turn AND s.closed), l AS (SELECT user_id, turn, max(event_id) FILTER (event_type = 'purchase') AS edit FROM e GROUP BY 1, 2) SELECT e.user_id, CAST(e.turn AS BIGINT) AS turn, count(DISTINCT k) FILTER (event_type = 'view') AS cited, count(DISTINCT k) FILTER (event_type = 'click') AS used, count(*) FILTER (event_type IN ('click', 'purchase')) AS actions, CASE WHEN edit IS NULL THEN 'none' WHEN bool_or(event_type = 'error' AND event_id > edit) THEN 'failed' ELSE 'passed' END AS outcome, count(*) FILTER (event_type = 'error') > 1 AS repeated FROM e JOIN l ON l.user_id = e.user_id AND l.turn = e.turn GROUP BY e.user_id, e.turn, edit")
def usage_evidence(events: DataFrame) -> DataFrame:
    """What closed turns cited and used, and how the checks after their last edit ended; open turns tell nothing yet."""
    turns = _turns(events)
    rows = turns.join(_judged(turns).select("user_id", "turn"), ["user_id", "turn"])
    kind = F.col("event_type")
    rows = rows.withColumn("edit", F.max(F.when(kind == "purchase", F.col("event_id"))).over(W.partitionBy("user_id", "turn")))
    late = F.bool_or((kind == "error") & (F.col("event_id") > F.col("edit")))
    out = rows.groupBy("user_id", "turn", "edit").agg(F.countDistinct(F.when(kind == "view", F.col("k"))).alias("cited"), F.countDistinct(F.when(kind == "click", F.col("k"))).alias("used"), F.count_if(kind.isin("click", "purchase")).alias("actions"), late.alias("late"), (F.count_if(kind == "error") > 1).alias("repeated"))
    return out.select("user_id", "turn", "cited", "used", "actions", F.when(F.col("edit").isNull(), "none").when(F.col("late"), "failed").otherwise("passed").alias("outcome"), "repeated")


@query("events", sql=f"WITH {_T}, r AS (SELECT user_id, k, max(event_id) AS newest FROM t WHERE turn > 0 AND event_type = 'view' GROUP BY 1, 2) SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC) AS place FROM r QUALIFY place <= 12")
def newest_rules(events: DataFrame) -> DataFrame:
    """The twelve rules that a session was given last, each once, newest first."""
    given = _turns(events).filter("event_type = 'view'").groupBy("user_id", "k").agg(F.max("event_id").alias("newest"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("newest"))).cast("long")
    return given.select("user_id", "k", place.alias("place")).filter("place <= 12")


@query("orders", "customer", "nation", sql="WITH RECURSIVE a AS (SELECT n_nationkey AS head, n_nationkey AS node FROM nation WHERE n_nationkey = 20 UNION SELECT head, node - 3 FROM a WHERE node - 3 >= 0), h AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) SELECT c_custkey, k, c_nationkey <> 20 AS elsewhere FROM h JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 20 OR c_nationkey IN (SELECT node FROM a)")
def branch_visibility(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Heads learnt on a branch (nation) are seen from another one only if its commit is an ancestor of the head: here each nation's
    parent is three below it."""
    from ..operators import graph

    parents = nation.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_nationkey") - 3).cast("long").alias("dst")).filter("dst >= 0")
    start = nation.sparkSession.createDataFrame([(20,)], "node long")
    seen = graph.reach(parents, start, 25 // 3 + 1).select(F.col("node").alias("branch"))
    heads = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("k"))
    rows = heads.join(customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("branch")), "c_custkey").join(seen, "branch", "left_semi")
    return rows.select("c_custkey", "k", (F.col("branch") != 20).alias("elsewhere"))


@query("embeddings", sql="WITH q AS (SELECT embedding AS q, label AS own FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS s FROM embeddings, q WHERE vec_id < 400 AND label <> own ORDER BY s DESC, id LIMIT 15")
def nearest_words(embeddings: DataFrame) -> DataFrame:
    """The fifteen nearest of the first rows of a table, without those of the same stem."""
    one = embeddings.filter("vec_id = 7").select(F.col("embedding").alias("q"), F.col("label").alias("own"))
    rows = embeddings.filter("vec_id < 400").crossJoin(F.broadcast(one)).filter("label <> own")
    return rows.select(F.col("vec_id").alias("id"), F.round(retrieval.dot(F.col("embedding"), F.col("q")), 6).alias("s")).orderBy(F.desc("s"), "id").limit(15)


_WORDS = "list_filter(regexp_extract_all(lower(p_name), '[a-z0-9_]+'), lambda w: length(w) >= 2)"


@query("part", sql=f"WITH p AS (SELECT *, len(list_intersect(list_distinct({_WORDS}), ['red', 'bolt'])) AS shared, 2 * len(list_intersect(list_distinct({_WORDS}), ['red', 'bolt'])) + CAST(p_type = 'SMALL' AS INT) AS s FROM part), z AS (SELECT p_brand, p_type, s, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY s DESC, p_partkey) AS r FROM p) SELECT p_brand, p_type, round(max(s) FILTER (r = 1) + CAST(0.1 AS DOUBLE) * coalesce(max(s) FILTER (r = 2), 0), 6) AS score FROM z WHERE r <= 2 GROUP BY 1, 2 ORDER BY score DESC, p_brand, p_type LIMIT 3")
def top_zones(part: DataFrame) -> DataFrame:
    """The three best zones: two for each word of the question in a name, one for its place, best and a tenth of the second best."""
    from ..functions import text

    shared = F.size(F.array_intersect(F.array_distinct(text.part_words(F.col("p_name"))), F.array(F.lit("red"), F.lit("bolt"))))
    rows = part.select("p_brand", "p_type", (2 * shared + (F.col("p_type") == "SMALL").cast("int")).alias("s"))
    place = F.row_number().over(W.partitionBy("p_brand", "p_type").orderBy(F.desc("s")))
    two = rows.withColumn("r", place).filter("r <= 2").groupBy("p_brand", "p_type").agg(F.max("s").alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("s"))), F.lit(0)).alias("second"))
    score = F.round(F.col("best") + 0.1 * F.col("second"), 6)
    return two.select("p_brand", "p_type", score.alias("score")).orderBy(F.desc("score"), "p_brand", "p_type").limit(3)


_CUT = f"SELECT p_partkey, p_name = 'red bolt' AS cited, p_brand = 'Brand#7' AS scoped, len(list_intersect(list_distinct({_WORDS}), ['red', 'bolt', 'small'])) AS shared, p_retailprice FROM part"


@query("part", sql=f"WITH r AS ({_CUT}), b AS (SELECT greatest(1, max(shared)) AS best FROM r) SELECT p_partkey, round(CASE WHEN cited THEN CAST(0.5 AS DOUBLE) WHEN scoped THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END + CAST(0.5 AS DOUBLE) * shared / best, 6) AS score FROM r, b WHERE (cited OR scoped OR shared >= 2) AND CASE WHEN cited THEN CAST(0.5 AS DOUBLE) WHEN scoped THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END + CAST(0.5 AS DOUBLE) * shared / best >= 0.35")
def relevance_cut(part: DataFrame) -> DataFrame:
    """Rules that are cited, in scope, or share two words with the question, from a score of 0.35 on."""
    from ..functions import text

    shared = F.size(F.array_intersect(F.array_distinct(text.part_words(F.col("p_name"))), F.array(*map(F.lit, ["red", "bolt", "small"]))))
    rows = part.select("p_partkey", (F.col("p_name") == "red bolt").alias("cited"), (F.col("p_brand") == "Brand#7").alias("scoped"), shared.alias("shared"))
    best = rows.agg(F.greatest(F.lit(1), F.max("shared")).alias("best"))
    score = F.when(F.col("cited"), 0.5).when(F.col("scoped"), 0.35).otherwise(0.25) + 0.5 * F.col("shared") / F.col("best")
    kept = rows.filter(F.col("cited") | F.col("scoped") | (F.col("shared") >= 2)).crossJoin(F.broadcast(best))
    return kept.filter(score >= 0.35).select("p_partkey", F.round(score, 6).alias("score"))
