"""Operators on event streams in batch: turns, windows, later use, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_turns(events: DataFrame, session: str, opens: Column, *order: str) -> DataFrame:
    """Adds turn_no; rows before the first opening event are dropped."""
    w = W.partitionBy(session).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("turn_no", F.sum(opens.cast("int")).over(w)).filter("turn_no > 0")


def later_within(session: str, condition: Column, *order: str) -> Column:
    """Whether a later row of the session meets the condition."""
    w = W.partitionBy(session).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    return F.coalesce(F.max(condition).over(w), F.lit(False))


def first_following(session: str, value: Column, condition: Column, *order: str) -> Column:
    """value of the first later row that meets the condition."""
    w = W.partitionBy(session).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    return F.first(F.when(condition, value), ignorenulls=True).over(w)


def last_before(session: str, value: Column, condition: Column, *order: str) -> Column:
    """value of the last row at or before this one that meets the condition."""
    w = W.partitionBy(session).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return F.last(F.when(condition, value), ignorenulls=True).over(w)
