"""What several corpus operators share: shared-folder tables, word splitting and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words remembered by a worker before its cache is emptied.
CACHE_WORDS = 300_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: Spark deletes the shuffle files of an execution when it ends, if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Shuffle partitions whose narrow rows share a file.
FILE_PARTITIONS = 16
#: Settings while a table is written. Rows go to Python in batches of so many bytes, as both sides hold a batch whole.
WRITING = {CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, one machine alone (master
    local[...], as in tests) gets a temporary one; a cluster gets an error, as its machines share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy", narrow: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors. The shuffle files of
    its job are deleted with its end. Narrow rows, ids and counts, are gathered in one file for each FILE_PARTITIONS
    shuffle partitions: without Hadoop's native library a local file costs an executor two processes."""
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // FILE_PARTITIONS))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing will read again."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_place(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """Rows with two more columns that tell each row from all others, and their names: the Parquet file it stands in and its
    place there, which are the same whenever the row is read. Rows that don't come straight from Parquet files are numbered; they
    must come in the same order each time."""
    file, row = (free_name(docs.columns, x) for x in ("from_file", "from_row"))
    try:
        return docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), (file, row)
    except AnalysisException:
        return docs.select("*", F.lit("").alias(file), F.monotonically_increasing_id().alias(row)), (file, row)


_HOLDER: list = [None, None]


def hold_caches(owner: str, clear: Callable[[], None] | None) -> None:
    """Called by an operator in a worker before it fills its caches (clear is None if it has none): those of the operator
    before it are emptied and what the allocators keep goes back, as workers live on from stage to stage."""
    if _HOLDER[0] != owner:
        if _HOLDER[1]:
            _HOLDER[1]()
            gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _HOLDER[:] = owner, clear


def sampled(rows: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """Of the distinct rows those n with the smallest hash (column h), or n for each value of a column of classes, whose
    sizes the driver gathers. A bound that about 2n rows of a class pass comes first, so that few rows move; rows that
    repeat count once, however often they do."""
    names = rows.columns
    kind = free_name(names, "kind")
    rows = rows.withColumn("h", F.xxhash64(*names)).withColumn(kind, F.col(by) if by else F.lit(0))
    sizes = rows.groupBy(kind).agg(F.approx_count_distinct("h")).collect()
    if not sizes:
        return rows.select(*names, "h")
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r[0], 2.0 * n / max(1, r[1]))))
    near = rows.filter(F.col("h") / 2.0**64 + 0.5 <= F.element_at(share, F.col(kind))).dropDuplicates([kind, "h"])
    near = near.withColumn("rank", F.row_number().over(W.partitionBy(kind).orderBy("h"))).filter(F.col("rank") <= n)
    return near.select(*names, "h")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text in UTF-8 (bytes.split() cuts at exactly these six characters)."""
    return text.encode().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Nothing is remembered: a hash takes less time than a look into a large table."""
    hold_caches("words", None)
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values, so that order by value is a random order."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n words; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * MULTIPLIER + hashes[i : i + count]
    return mixed(out)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit hash of an array."""
    digest = xxhash.xxh3_128_digest(np.ascontiguousarray(values).tobytes())
    return tuple(int(x) for x in np.frombuffer(digest, np.int64))


def small_slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows and bytes of a column (or one row), so that long texts don't
    pile up as Python objects."""
    for batch in batches:
        at, n = batch.schema.get_field_index(column), batch.num_rows
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)) if at >= 0 else np.zeros(n, np.int64)
        i = 0
        while i < n:
            j = min(i + rows, max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right"))))
            yield batch.slice(i, j - i)
            i = j


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal keys in batches sorted by them: (keys, slices of batches)."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *changes.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield last, held
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held
