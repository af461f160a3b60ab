"""Queries over the driver's tables and the SQL that checks them. Modules of plans/ register theirs with @query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _streamed(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream of files. A stream reads folders: of a table in one file it is the folder, by that name."""
    table, (folder, name) = spark.read.parquet(path), path.rsplit("/", 1)
    stream = spark.readStream.schema(table.schema)
    if all(f.endswith(f"/{name}") for f in table.inputFiles()):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def query(*tables: str, sql: str | None = None, stream: bool = False) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of the named tables (streams, if so said) as a query of its own name."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        read = _streamed if stream else lambda spark, path: spark.read.parquet(path)
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(*(read(spark, f"{sf_dir}/{t}.parquet") for t in tables))
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def _load() -> None:
    from .plans import code, delivery, graph, history, judgement, paths, ranking, records, relational, retrieval, selection, session, store  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
