"""Order-dependent selection: prefixes, folds that skip what no longer fits, ledgers of delivered keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: keys that a session's ledger remembers.
LEDGER = 256


def prefix_within(rows: DataFrame, key: str, size: Column, most: int, budget: int, *order: str) -> DataFrame:
    """Rows of each key in order, up to the first that exceeds the count or the running size."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).withColumn("_sum", F.sum(size).over(w))
    return numbered.filter((F.col("_n") <= most) & (F.col("_sum") <= budget)).drop("_n", "_sum")


def _fold(most: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, total = object(), 0, 0
        for batch in batches:
            keep = []
            for key, size in zip(batch.column("_key").to_pylist(), batch.column("_size").to_pylist(), strict=True):
                if key != last:
                    last, count, total = key, 0, 0
                taken = count < most and total + size <= budget
                count, total = count + taken, total + taken * size
                keep.append(taken)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def skip_fold(rows: DataFrame, key: str, size: Column, most: int, budget: int, *order: str | Column) -> DataFrame:
    """Rows of each key in order; one that exceeds the count or the total size is skipped and the next one tried.

    What is taken depends on all rows before, so a key's rows pass one task in order. Only running totals are held there,
    and rows that can't fit alone don't travel. Columns besides the rows' own: none."""
    sized = rows.withColumn("_key", F.col(key)).withColumn("_size", F.coalesce(size.cast("long"), F.lit(0)))
    sized = sized.filter(F.col("_size") <= budget).repartition("_key").sortWithinPartitions("_key", *order)
    return sized.mapInArrow(_fold(most, budget), sized.schema).drop("_key", "_size")


def ledger(rows: DataFrame, session: str, key: str, order: str) -> DataFrame:
    """session, key, first (order of the first delivery), pos (from 1), held: whether it is among the last LEDGER keys."""
    first = rows.groupBy(session, key).agg(F.min(order).alias("first"))
    w = W.partitionBy(session)
    return first.withColumn("pos", F.row_number().over(w.orderBy("first"))).withColumn("held", F.col("pos") > F.count("*").over(w) - LEDGER)
