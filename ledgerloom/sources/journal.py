"""Journals of JSON lines, records written once, and word vectors as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: words of a vector table.
MOST_WORDS = 40_000

ITEM = "struct<key:string,files:array<string>,code:array<struct<file:string,shape:array<string>,loc:bigint>>>"
#: A line tells what a session was given (`inject`) or which tool it used (`tool`).
USAGE = f"t timestamp, s string, k string, e string, tokens bigint, items array<{ITEM}>, tool string, file string"


def read_journal(spark: SparkSession, paths: list[str], schema: str = USAGE) -> DataFrame:
    """Rows of JSON lines; torn lines are left out."""
    full = T._parse_datatype_string(schema).add("_torn", T.StringType())
    # Lines are read as text, as Spark's reader refuses to count rows by their torn lines alone.
    rows = spark.read.text(paths).select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"))
    return rows.filter("r is not null and r._torn is null").select("r.*").drop("_torn")


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_once(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key is not there yet, one for each key. For one writer at a time."""
    spark = rows.sparkSession
    new = rows.dropDuplicates([key])
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti").select(*rows.columns)
    new.write.mode("append").parquet(path)


def unit_int8(vector: Column) -> Column:
    """A vector of length 1 in steps of 1/127; halves go up."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.when(length > 0, F.floor(x / length * 127 + 0.5)).otherwise(0).cast("tinyint"))


def read_word_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """word, vector of a text table: one word and its numbers on each line. Lines of another length (a header) are left
    out; the first line of a word counts; at most MOST_WORDS words, the feature of this source."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("row"), parts.alias("p")).filter(F.size("p") == dimension + 1)
    rows = rows.select("row", F.lower(F.get("p", F.lit(0))).alias("word"), F.slice("p", 2, dimension).cast("array<double>").alias("v"))
    first = rows.groupBy("word").agg(F.min("row").alias("row"), F.min_by("v", "row").alias("v")).orderBy("row").limit(MOST_WORDS)
    return first.select("word", unit_int8(F.col("v")).alias("vector"))
