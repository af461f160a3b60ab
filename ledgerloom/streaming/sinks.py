"""Streams into tables: rebuilding when files change, batches under one owner, chunks to others, writes that check a revision.

A streaming query owns its checkpoint, so one rebuild or batch runs at a time and a failed one runs again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

# Operations of one push, captures of one flush, attempts to write.
CHUNK, FLUSH, ATTEMPTS = 100, 500, 3


class Conflict(RuntimeError):
    """Someone else wrote first."""


def watch(spark: SparkSession, folder: str, state: str, rebuild: Callable[[DataFrame], None], every: str | None = "10 seconds") -> StreamingQuery:
    """Calls rebuild(path, modificationTime, length of the changed files) for each batch of files that are new or have changed; all there is and
    then no more if `every` is None."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    writer = files.writeStream.option("checkpointLocation", state).foreachBatch(lambda batch, _: rebuild(batch))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def appended(stream: DataFrame, key: str, path: str, state: str) -> StreamingQuery:
    """Adds rows whose key the table doesn't hold; a batch that runs again adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        spark, rows = batch.sparkSession, batch.dropDuplicates([key])
        from ..sources.knowledge import read_or_empty

        known = read_or_empty(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema))
        rows.join(known.select(key), key, "left_anti").select(*batch.columns).write.mode("append").parquet(path)

    return stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(add).start()


def chunks(operations: DataFrame, sent: DataFrame) -> DataFrame:
    """operations(id, seq, ...), sent(id) -> those not sent yet, with the number of the push that takes them. Ranks are worked out within ranges of
    seq of at most CHUNK rows on average, so no task sees them all."""
    open_ = operations.join(sent.select("id"), "id", "left_anti")
    low, high, n = open_.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    if not n:
        return open_.withColumn("push", F.lit(0).cast("long"))
    wide = max(1, -(-(high - low + 1) * CHUNK // n))
    rows = open_.withColumn("part", F.expr(f"(seq - {low}) div {wide}"))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("seq", "id")) - 1)
    return rows.withColumn("push", F.col("part") * (wide + 1) + F.expr(f"k div {CHUNK}")).drop("part", "k")


def committed(read: Callable[[], tuple[str, DataFrame]], change: Callable[[DataFrame], DataFrame], write: Callable[[str, DataFrame], bool]) -> DataFrame:
    """Reads a revision and its table, changes it, and writes unless the revision has moved on; tries again with the new one."""
    for _ in range(ATTEMPTS):
        revision, table = read()
        new = change(table)
        if write(revision, new):
            return new
    raise Conflict(f"not written in {ATTEMPTS} attempts")
