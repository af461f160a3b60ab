"""Places that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, one machine alone (master local[...], as in tests) gets a
    temporary one; a cluster gets an error, as its machines share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept_path(table: DataFrame, name: str) -> str:
    """A folder under spark.checkpoint.dir for what is derived from a table of files: the same as long as its files are (names, sizes, times)."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    key = files.agg(F.coalesce(F.sum(F.xxhash64("*").cast("decimal(38,0)")), F.lit(0)).alias("h")).first().h
    base = shared_path(table.sparkSession, "").rsplit("/", 1)[0]
    return f"{base}/{name}-{int(key) % 2**64:016x}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: worked out once, however often it is read, and safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_in_rocksdb(spark: SparkSession) -> None:
    """Streams with state variables and timers need this store; others work with it as well."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
