"""Operators on edge tables: inversion, degree, level-by-level reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written

#: Members of a place that one row deals out.
BLOCK = 256


def inverted(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: distinct targets out and distinct sources in; both counts in one aggregate."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def reach(edges: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """node, depth: nodes within `depth` steps of starts(node) along src -> dst at their first level."""
    return reach_via(edges, starts, depth).drop("via")


def reach_via(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """node, depth, via: as reach(), with the smallest of the nodes from which it was first reached.

    Edges are written once, and each level: a level joins only the one before it with them and drops what is known."""
    edges = written(edges.select("src", "dst"), "edges") if depth > 1 else edges
    kind = starts.schema["node"].dataType
    frontier = starts.select("node").distinct().withColumns({"depth": F.lit(0), "via": F.lit(None).cast(kind)})
    seen = frontier
    for level in range(1, depth + 1):
        steps = frontier.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        frontier = steps.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"), "via")
        if level < depth:
            frontier = written(frontier, "level")
        seen = seen.unionByName(frontier)
    return seen


def chains(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """node, level, cycle: every path from starts(node) of up to `depth` steps; one that meets itself ends as a cycle."""
    front = starts.select("node", F.array("node").alias("path"), F.lit(0).alias("level"), F.lit(False).alias("cycle"))
    out = front
    for level in range(1, depth + 1):
        step = front.filter("not cycle").join(edges, F.col("node") == F.col("src")).withColumn("cycle", F.array_contains("path", F.col("dst")))
        front = step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.lit(level).alias("level"), "cycle")
        out = out.unionByName(front)
    return out.drop("path")


def reach_within(edges: DataFrame, starts: DataFrame, depth: int, nodes: int) -> DataFrame:
    """node, depth, via, cut: as reach_via(), but never more than `nodes` nodes with the starts; a level takes its first ones by
    name, and `cut` on them says that others were left out. Levels are bounded by `nodes`, so the driver holds them."""
    spark = edges.sparkSession
    seen = {r.node: (0, None, False) for r in starts.select("node").distinct().orderBy("node").limit(nodes).collect()}
    kind = next(f.dataType.simpleString() for f in edges.schema if f.name == "dst")
    frontier = list(seen)
    for level in range(1, depth + 1):
        if not frontier:
            break
        room = nodes - len(seen)
        near = edges.filter(F.col("src").isin(frontier) & ~F.col("dst").isin(list(seen)))
        rows = near.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via")).orderBy("node").limit(room + 1).collect()
        cut = len(rows) > room
        seen.update({r.node: (level, r.via, cut) for r in rows[:room]})
        if cut:
            if not room:
                seen[frontier[0]] = (*seen[frontier[0]][:2], True)
            break
        frontier = [r.node for r in rows]
    return spark.createDataFrame([(n, *x) for n, x in seen.items()], f"node {kind}, depth int, via {kind}, cut boolean")


def _summed(held: list[np.ndarray]) -> list[np.ndarray]:
    """a, b, x, y, c: one of each a and b, in their order, with the sum of c."""
    a, b, x, y, c = held
    if not len(a):
        return held
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return [a[first], b[first], x[order][first], y[order][first], np.add.reduceat(c[order], first)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, x, bs, ys sorted by a -> a, b, x, y, c. Only sums of the last a are kept from batch to batch."""
    held, schema = [np.empty(0, np.int64)] * 5, None
    out = lambda part: pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(part, schema, strict=True)], names=["a", "b", "x", "y", "c"])
    for batch in batches:
        bs, ys = batch.column("bs"), batch.column("ys")
        kind = batch.schema.field("a").type
        schema = [kind, kind, pa.int64(), pa.int64(), pa.int64()]
        times = np.diff(bs.offsets.to_numpy())
        a, x = (np.repeat(batch.column(n).to_numpy(), times).astype(np.int64) for n in ("a", "x"))
        new = [a, bs.flatten().to_numpy().astype(np.int64), x, ys.flatten().to_numpy(), np.ones(len(a), np.int64)]
        held = _summed([np.concatenate(v) for v in zip(held, new, strict=True)])
        done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if done:
            yield out([v[:done] for v in held])
            held = [v[done:] for v in held]
    if len(held[0]):
        yield out(held)


def met(rows: DataFrame, kind: str) -> DataFrame:
    """rows(k integer, p, n), each k and p once -> a, b, x, y, c: in how many p two k meet (a < b), with their n. A place's list goes to each of its members as one row with those
    after it, so no row is shuffled for a pair in a place, and each a is summed up where its rows are; blocks of a long list go to many tasks. What is held is
    a list, or the sums of one a: no more than there are k."""
    lists = rows.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("m")).filter("size(m) > 1")
    blocks = lists.select("p", F.col("m.k").alias("ks"), F.col("m.n").alias("ns"), F.explode(F.expr(f"sequence(0, (size(m) - 1) div {BLOCK})")).alias("block")).repartition("p", "block")
    each = blocks.select("ks", "ns", "block", F.posexplode(F.slice("ks", F.col("block") * BLOCK + 1, BLOCK)).alias("i", "a"))
    at = (F.col("block") * BLOCK + F.col("i")).cast("int")
    later = each.select("a", F.get("ns", at).alias("x"), F.slice("ks", at + 2, F.size("ks")).alias("bs"), F.slice("ns", at + 2, F.size("ns")).alias("ys")).filter("size(bs) > 0")
    return later.repartition("a").sortWithinPartitions("a").mapInArrow(_counted, f"a {kind}, b {kind}, x long, y long, c long")
