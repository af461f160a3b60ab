"""Operators of the append-only store: heads, as-of views, chains, validity, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def heads(versions: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest version of each key: a partial aggregate, no sort."""
    newest = F.max_by(F.struct(*versions.columns), F.struct(*order))
    return versions.groupBy(key).agg(newest.alias("head")).select("head.*")


def as_of(versions: DataFrame, recorded: str, at: Column) -> DataFrame:
    return versions.filter(F.col(recorded) <= at)


def chain(versions: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds version (1, 2, ...), and previous (the first order column's last value)."""
    w = W.partitionBy(key).orderBy(*order)
    return versions.withColumn("version", F.row_number().over(w)).withColumn("previous", F.lag(order[-1]).over(w))


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """start <= at < end; a missing bound is open."""
    return F.coalesce(start <= at, F.lit(True)) & F.coalesce(at < end, F.lit(True))


def semi_any(rows: DataFrame, *branches: DataFrame) -> DataFrame:
    """Rows that meet one of several semi joins, each row once, also where rows are equal. A branch is a table of wanted values."""
    hits = []
    for k, wanted in enumerate(branches):
        hit = f"__hit_{k}"
        rows = rows.join(wanted.distinct().withColumn(hit, F.lit(True)), wanted.columns, "left")
        hits.append(F.col(hit))
    return rows.filter(F.coalesce(*hits)).drop(*[f"__hit_{k}" for k in range(len(branches))])


def upsert(target: DataFrame, source: DataFrame, key: str, version: str) -> DataFrame:
    """source replaces a row of target if its version is higher; otherwise new keys are added."""
    both = target.unionByName(source)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("row")).select("row.*")


def insert_or_ignore(target: DataFrame, source: DataFrame, *key: str) -> DataFrame:
    return target.unionByName(source.dropDuplicates(list(key)).join(target, list(key), "left_anti").select(*target.columns))
