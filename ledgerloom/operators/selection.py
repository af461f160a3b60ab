"""Rules for a message, from rules(idx, content, vector array<double>, depth): orders by words, by meaning and by a reader, their
fusion, and the rules that come along with the first ones. Rules are those of one store; an order places each of them once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from . import retrieval

# Rules that are read, rules that bring others, how far the closest is looked for, recorded links of one rule;
# from how many on a pool is a crowd, the share above the line that makes it one, and how many of a crowd stay.
POOL, LINKED_FROM, REACH, TIED, CROWD, SHARE, KEPT = 40, 2, 3, 2, 16, 0.75, 4

#: Pool(idx, content) -> (idx, score).
Reader = Callable[[DataFrame], DataFrame]


def placed(rows: DataFrame, *by) -> DataFrame:
    """idx, rank from 0 in an order."""
    return rows.select("idx", (F.row_number().over(W.orderBy(*by)) - 1).alias("rank"))


def by_words(rules: DataFrame, message: str | None = None, like: int | None = None) -> DataFrame:
    """idx, rank by the words that a rule shares with a message, or with another rule."""
    docs = rules.select(F.col("idx").alias("id"), text.part_words(F.col("content")).alias("tokens"))
    asked = rules.sparkSession.createDataFrame([(message,)], "content string") if like is None else rules.filter(F.col("idx") == like)
    query = asked.select(F.array_distinct(text.part_words(F.col("content"))).alias("q")).first().q
    scores = retrieval.bm25(docs, query or [""]).withColumnRenamed("id", "idx")
    return placed(rules.select("idx").join(scores, "idx", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), F.desc("score"), "idx")


def by_meaning(rules: DataFrame, vector: list[float]) -> DataFrame:
    """idx, rank of the rules that have a vector by its closeness."""
    near = retrieval.dot(F.col("vector"), F.array(*(F.lit(float(x)) for x in vector)))
    return placed(rules.filter("vector is not null").select("idx", near.alias("score")), F.desc("score"), "idx")


def inserted(order: DataFrame, others: DataFrame) -> DataFrame:
    """An order with others(idx, rank) put in, one after another, each at its own rank or at the end. What stands before a place is known
    from the ranks alone, so one sort does it."""
    late = others.withColumn("k", F.row_number().over(W.orderBy("rank")) - 1).crossJoin(F.broadcast(order.agg(F.count("*").alias("n"))))
    # Of those in the order, as many come before as its place holds less those put in earlier.
    late = late.select("idx", (F.least("rank", F.col("n") + F.col("k")) - F.col("k")).alias("before"), F.lit(0).alias("kind"), "k")
    return placed(order.select("idx", F.col("rank").alias("before"), F.lit(1).alias("kind"), F.lit(0).alias("k")).unionByName(late), "before", "kind", "k")


def first_lists(rules: DataFrame, message: str, vector: list[float] | None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Order by words, order by meaning, and the pool(idx, rank): the first ones of both, or of the words alone."""
    words = by_words(rules, message)
    if vector is None:
        return words, None, words.filter(F.col("rank") < POOL)
    unknown = words.join(rules.filter("vector is null").select("idx"), "idx", "left_semi")
    meaning = inserted(by_meaning(rules, vector), unknown)
    half = [x.filter(F.col("rank") < POOL // 2).select("idx", (F.col("rank") + k * POOL).alias("rank")) for k, x in enumerate((words, meaning))]
    return words, meaning, placed(half[0].unionByName(half[1]).groupBy("idx").agg(F.min("rank").alias("rank")), "rank")


def closest(rules: DataFrame, idx: int, n: int) -> list[int]:
    """The n rules closest to one, by words and, if it has a vector, by meaning."""
    words, own = by_words(rules, like=idx), rules.filter((F.col("idx") == idx) & F.col("vector").isNotNull()).select("vector").collect()
    order = words.select("idx", (-F.col("rank").cast("double")).alias("score"))
    if own:
        order = retrieval.fused(*(x.withColumnRenamed("idx", "id") for x in (words, by_meaning(rules, own[0].vector)))).withColumnRenamed("id", "idx")
    return [r.idx for r in order.filter(F.col("idx") != idx).orderBy(F.desc("score"), "idx").limit(n).collect()]


def both_ways(links: DataFrame, rules: DataFrame) -> DataFrame:
    """links(a, b) -> each in both directions, none of a rule with itself, both ends among the rules."""
    pairs = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    return pairs.join(rules.select(F.col("idx").alias("a")), "a", "left_semi").join(rules.select(F.col("idx").alias("b")), "b", "left_semi").select("a", "b")


def _tied(links: DataFrame | None, rules: DataFrame, idx: int) -> list[int]:
    if links is None:
        return []
    return [r.b for r in both_ways(links, rules).filter(F.col("a") == idx).orderBy("b").collect()]


def rank_rules(rules: DataFrame, message: str, vector: list[float], read: Reader, links: DataFrame | None = None) -> DataFrame:
    """idx, position: every rule once, best first. The first two each bring a linked rule, or the one closest to them."""
    words, meaning, pool = first_lists(rules, message, vector)
    score = lambda *orders: retrieval.fused(*(o.withColumnRenamed("idx", "id") for o in orders)).withColumnRenamed("id", "idx")
    read_first = read(rules.join(pool, "idx", "left_semi").select("idx", "content")).select("idx", F.lit(0).alias("part"), "score")
    rest = score(words, meaning).join(pool.select("idx"), "idx", "left_anti").select("idx", F.lit(1).alias("part"), "score")
    orders = [words, meaning, placed(read_first.unionByName(rest), "part", F.desc("score"), "idx")]
    scoped = rules.filter("depth > 0").select("idx", "depth")
    merged = placed(score(*orders, placed(scoped, F.desc("depth"), "idx")), F.desc("score"), "idx")
    two = [r.idx for r in merged.filter(F.col("rank") < LINKED_FROM).orderBy("rank").collect()]
    added: list[int] = []
    for i in two:
        # Of the closest, two and those added before can be taken already.
        added += [j for j in [*_tied(links, rules, i), *closest(rules, i, 2 * LINKED_FROM)] if j not in two and j not in added][:1]
    ahead = [*two, *added]
    place = F.when(F.col("idx").isin(ahead), F.array_position(F.array(*map(F.lit, ahead)), F.col("idx")) - 1 - len(ahead)).otherwise(F.col("rank")) if ahead else F.col("rank")
    return placed(merged.withColumn("place", place), "place").withColumnRenamed("rank", "position")


def select_rules(rules: DataFrame, message: str, vector: list[float] | None, read: Reader, line: float, low: float, links: DataFrame | None = None) -> list[int]:
    """The rules a message needs, best first: those that a reader scores at the line or above, or the best two from the lower line on; a few
    of a crowd that the line doesn't tell apart. The first two bring recorded links, or the closest rule there is nearby.

    The pool has POOL rules at most, so the driver decides over it."""
    _, _, pool = first_lists(rules, message, vector)
    scores = read(rules.join(pool, "idx", "left_semi").select("idx", "content"))
    ranked = [(r.score, r.idx) for r in scores.orderBy(F.desc("score"), "idx").collect()]
    above = sum(s >= line for s, _ in ranked)
    apart = len(ranked) < CROWD or above <= len(ranked) * SHARE
    kept = [i for k, (s, i) in enumerate(ranked) if (s >= line or (k < LINKED_FROM and s >= low) if apart else k < KEPT)]
    linked: list[int] = []
    for i in kept[:LINKED_FROM]:
        free = lambda j: j not in kept and j not in linked  # noqa: B023, E731
        recorded = _tied(links, rules, i)
        linked += [j for j in recorded if free(j)][:TIED] if recorded else [j for j in closest(rules, i, REACH) if free(j)][:1]
    return [*kept[:LINKED_FROM], *linked, *kept[LINKED_FROM:]]
