"""Connected components of an edge table, without gathering links or nodes on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Up to so many edges one task merges them; beyond, tasks pass labels along. Both give the same labels.
FEW = 500_000


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> each node with the smallest node of its component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    nodes = list(up)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "label"])


def connected(edges: DataFrame, few: int = FEW) -> DataFrame:
    """edges(a, b), a table -> (node, label): label is the smallest node reachable, for every node of an edge. Empty in, empty out.

    Many edges: each round lowers a node's label to the smallest label among its neighbours and then to its label's own
    label (pointer jumping), so stars end in two rounds and chains in about log2 of their length."""
    if edges.count() <= few:
        return written(edges.select("a", "b").coalesce(1).mapInArrow(_merged, "node long, label long"), "labels")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = lowered.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) < F.col("label")).alias("moved"))
        before, after = labels, written(after, "labels")
        discard(before)
        if not after.filter("moved").limit(1).count():
            break
        labels = after
    labels = after.select("node", "label")
    labels.written_to = after.written_to
    return labels
