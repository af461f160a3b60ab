"""Vectors beside a store: int8 ones of knowledge by word table, and float32 ones of modules in the binary form."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits

#: A vector of no numbers says that no word of the text is known.
STORED = "knowledge_id string, version_id string, table_id string, vec array<tinyint>"
#: Rows of a module matrix that one task reads.
ROWS = 4096


def save_vectors(spark: SparkSession, path: str, table_id: str, rows: DataFrame) -> int:
    """rows(knowledge_id, version_id, vec array<tinyint> or null): each takes the place of its knowledge's vector, whatever table that is of; gives the revision."""
    base = commits.revision(spark, path)
    new = rows.select("knowledge_id", "version_id", F.lit(table_id).alias("table_id"), F.coalesce("vec", F.array().cast("array<tinyint>")).alias("vec")).dropDuplicates(["knowledge_id"])
    old = commits.table(spark, path, "vectors", STORED, base).join(new.select("knowledge_id"), "knowledge_id", "left_anti")
    return commits.commit(spark, path, base, {}, {"vectors": old.unionByName(new)})


def stored_vectors(spark: SparkSession, path: str, table_id: str, heads: DataFrame) -> DataFrame:
    """knowledge_id, vec of the active heads(knowledge_id, id, state, ...) whose version it is of, for a table; those without a known word have none."""
    now = heads.filter("state = 'active'").select("knowledge_id", F.col("id").alias("version_id"))
    rows = commits.table(spark, path, "vectors", STORED).filter((F.col("table_id") == table_id) & (F.size("vec") > 0))
    return rows.join(now, ["knowledge_id", "version_id"], "left_semi").select("knowledge_id", "vec")


def without_vector(spark: SparkSession, path: str, table_id: str, heads: DataFrame) -> DataFrame:
    """knowledge_id, version_id, content of the active heads that have no vector of this version and table."""
    done = commits.table(spark, path, "vectors", STORED).filter(F.col("table_id") == table_id).select("knowledge_id", "version_id")
    rows = heads.filter("state = 'active'").select("knowledge_id", F.col("id").alias("version_id"), "content")
    return rows.join(done, ["knowledge_id", "version_id"], "left_anti")


def save_module_vectors(vectors: DataFrame, path: str) -> int:
    """vectors(id, vec) -> parts of a float32 matrix with the ids of their rows: each row of the table holds up to ROWS modules in the order of ids, its numbers as
    little-endian bytes. All vectors are of one length, which it gives."""
    sizes = [r.n for r in vectors.select(F.size("vec").alias("n")).distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError(f"vectors of one length are needed, not of {sorted(sizes)}")
    dim = sizes[0]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at : at + ROWS]
                flat = [float(x) for v in part["vec"] for x in v]
                yield pd.DataFrame({"dim": [dim], "ids": [json.dumps(part["id"].tolist())], "matrix": [struct.pack(f"<{len(flat)}f", *flat)]})

    parts = max(1, math.ceil(vectors.count() / ROWS))
    rows = vectors.select("id", "vec").repartitionByRange(parts, "id").sortWithinPartitions("id")
    rows.mapInPandas(pack, "dim int, ids string, matrix binary").write.mode("overwrite").parquet(path)
    return dim


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for dim, ids, matrix in zip(frame["dim"], frame["ids"], frame["matrix"], strict=True):
            names = json.loads(ids)
            if len(matrix) != 4 * dim * len(names):
                raise ValueError("a matrix does not hold a row for each of its ids")
            yield pd.DataFrame({"id": names, "vec": [list(struct.unpack_from(f"<{dim}f", matrix, 4 * dim * i)) for i in range(len(names))]})


def load_module_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, vec array<float> of the modules."""
    return spark.read.schema("dim int, ids string, matrix binary").parquet(path).mapInPandas(_unpack, "id string, vec array<float>")
