"""Neighbours of words, kept from request to request: a table of at most LIMIT words, the oldest of which go first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.sinks import Conflict
from . import commits, observed

#: Fixed value: words that are kept.
LIMIT = 2000
ROWS = "word string, near array<struct<s:double,word:string>>, entered long"


def kept(spark: SparkSession, path: str) -> DataFrame:
    return commits.table(spark, path, "neighbours", ROWS)


def neighbours(words: DataFrame, vectors: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """words(word), vectors(word, row, vec) -> word, near: from the table where it has them; the others are worked out and enter it, each under the number of its entry.
    Nothing is worked out or written if all are known. If another writer comes first, the result is the same and not kept."""
    spark = words.sparkSession
    base = commits.revision(spark, path)
    old = commits.table(spark, path, "neighbours", ROWS, base)
    asked = words.select("word").distinct()
    missing = asked.join(old, "word", "left_anti")
    known = old.join(asked, "word", "left_semi").select("word", "near")
    if missing.isEmpty():
        return known
    last = old.agg(F.coalesce(F.max("entered"), F.lit(0))).first()[0]
    # A request has few words; a word without a vector has no neighbours, which is known from then on.
    found = missing.join(observed.neighbours(missing, vectors), "word", "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<s:double,word:string>>")))
    found = spark.createDataFrame([(r.word, r.near, last + i) for i, r in enumerate(found.orderBy("word").collect(), 1)], ROWS)
    every = old.unionByName(found).orderBy(F.desc("entered")).limit(limit)
    try:
        done = commits.commit(spark, path, base, {}, {"neighbours": every.coalesce(1)})
        commits.forget(spark, path, done - 1)  # readers of the one before may still be reading
    except Conflict:
        pass
    return known.unionByName(found.select("word", "near"))
