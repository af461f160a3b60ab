"""Places in one order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import written

#: Most ranges that rows are dealt to; the driver holds a count for each.
RANGES = 2000


def numbered(rows: DataFrame, *by: Column | str, name: str = "rank", start: int = 0) -> DataFrame:
    """rows with their place, from `start` on, in the order of `by`, which tells all rows apart. Rows are dealt to ranges of the order and written, each
    range is numbered by itself, and a range begins where the counts of those before it end."""
    ranges = min(RANGES, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = written(rows.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dict(dealt.groupBy("_range").count().collect())
    before, total = [], start
    for part in range(ranges):
        before.append(total)
        total += counts.get(part, 0)
    first = F.element_at(F.array(*(F.lit(x).cast("long") for x in before)), F.col("_range") + 1)
    return dealt.withColumn(name, F.row_number().over(W.partitionBy("_range").orderBy(*by)) - 1 + first).drop("_range")
