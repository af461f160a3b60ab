"""A trie of conversations by their turns, dealt out by first turns.

A turn is known by a digest of its role and text (the first 16 bytes of their SHA-256) and the text's number of code points, so
texts stay where they are read. A conversation becomes one row with its turns in order; conversations with the same turns
become one row with their number, smallest id and the hash of all their ids, so copies weigh nothing further on. These rows are
dealt by the digest of their first turn into buckets; each bucket's tries are built by applyInPandas, with a dictionary of
children in each node, and summed in postorder without recursion.

A first turn under which more than `limit` turns stand is not built in one task. Its conversations go on to the next round, dealt
by the next turn in which they differ, and so on until each part is small; the turns they have in common up to there are one
row of a table, whose nodes are made from the sums of the parts, deepest round first. Sums and smallest ids that a part needs from above come
down with its rows.

Turns are ordered by their number, null first; turns with the same number by their digest. Null roles and texts count as empty.
Rows without conv_id belong to no conversation and are left out; repeated rows are turns of their own; texts may be of any
length; further columns are ignored. Without conversations there is no node, not even a root. The digests of one conversation (about 30 bytes
a turn) are held in one row. Ids of copies are gathered in blocks of IDS neighbouring ids, and hashed as a stream in their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, written

#: Turns under one top node that one task builds, and neighbouring ids in one row while they are gathered.
LIMIT, IDS = 20_000, 1024
#: Turns that any conversation takes from another one, at most, and conversations that share one of these.
HEAD, SHARE = 5, 100
NOTHING = hashlib.sha256(b"").hexdigest()
ROOT = b""
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODES = "above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def paths(conversations: DataFrame, *keys: str) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, path: its turns in order, each as (turn, size), a digest and a number
    of code points. With `keys`, expressions over conv_id, rows are dealt by these and keep them as columns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("at"), digest.alias("turn"), F.length(text).alias("size")).alias("t"))
    names = [f"key{i}" for i in range(len(keys))]
    turns = turns.select("*", *(F.expr(e).alias(n) for n, e in zip(names, keys, strict=True)))
    if keys:
        turns = turns.repartition(*names)
    held = turns.groupBy(*names, "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select(*names, "conv_id", F.transform("t", lambda t: F.struct(t["turn"].alias("turn"), t["size"].alias("size"))).alias("path"))


def with_shared_heads(conversations: DataFrame) -> DataFrame:
    """paths() where every conversation c begins with the first h turns of conversation c - c % SHARE in place of its own, h =
    crc32(decimal c) % (HEAD + 1); none if that one is missing, all if it has fewer."""
    held = paths(conversations, f"conv_id - conv_id % {SHARE}")
    head = F.max(F.when(F.col("conv_id") == F.col("key0"), F.slice("path", 1, HEAD))).over(W.partitionBy("key0"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    held = held.withColumn("head", head).withColumn("h", h)
    own = F.slice("path", F.col("h") + 1, F.size("path"))
    return held.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("path"))


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (same, block) -> a row for each `same`, with ends_sha256 of the ids of its blocks, one after the other."""
    held, same, n, low, ids = None, None, 0, 0, None

    def done() -> pa.RecordBatch:
        values = [held.column("path"), pa.array([n], pa.int64()), pa.array([low], pa.int64()), pa.array([ids.hexdigest()])]
        return pa.RecordBatch.from_arrays(values, names=["path", "n", "low", "ends"])

    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("same", "n", "low", "ids"))
        for i, (key, count, first, text) in enumerate(zip(*columns, strict=True)):
            if key != same:
                if held is not None:
                    out.append(done())
                held, same, n, low, ids = batch.slice(i, 1), key, 0, first, hashlib.sha256()
            elif n:
                ids.update(b",")
            n += count
            ids.update(text.encode())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if held is not None:
        yield done()


def distinct_paths(held: DataFrame) -> DataFrame:
    """conv_id, path -> path, n (conversations with it), low (the smallest id), ends (SHA-256 of their ids, ascending, comma-joined)."""
    same = _digest(F.array_join(F.transform("path", lambda t: F.hex(t["turn"])), "").cast("binary"))
    blocks = held.withColumn("same", same).groupBy("same", F.expr(f"conv_id div {IDS}").alias("block"))
    blocks = blocks.agg(F.first("path").alias("path"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("same", "block", "path", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("low"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    blocks = blocks.repartition("same").sortWithinPartitions("same", "block")
    kind = blocks.schema["path"].dataType.simpleString()
    return blocks.mapInArrow(_hashed_ids, f"path {kind}, n long, low long, ends string")


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket: of the top nodes that its rows name, and of all below them."""
    tops: dict[bytes, int] = {}
    kids: list[dict[bytes, int]] = []
    up, depths, sizes, counts, lows, ends, above, parents = [], [], [], [], [], [], [], []

    def node(parent: int, depth: int, size: int, key: bytes | None, low: int) -> int:
        kids.append({})
        for column, value in ((up, parent), (depths, depth), (sizes, size), (counts, 0), (lows, low), (ends, NOTHING), (above, key), (parents, None)):
            column.append(value)
        return len(up) - 1

    for key, top, depth, parent, turns, lengths, n, low, end in zip(*(rows[c] for c in ("above", "top", "depth", "parent", "turns", "sizes", "n", "low", "ends")), strict=True):
        at = tops.get(top)
        if at is None:
            at = tops[top] = node(-1, depth, int(lengths[0]), key, low)
            parents[at] = parent
        for k in range(len(turns)):
            if k:
                child = kids[at].get(turns[k])
                if child is None:
                    child = kids[at][turns[k]] = node(at, depth + k, int(lengths[k]), None, low)
                at = child
            counts[at] += n
            lows[at] = min(lows[at], low)
        ends[at] = end
    leaves, saved = [0] * len(up), [0] * len(up)
    for i in range(len(up) - 1, -1, -1):  # children come after their parents
        leaves[i] = leaves[i] or 1
        saved[i] += (counts[i] - 1) * sizes[i]
        if up[i] >= 0:
            parents[i] = lows[up[i]]
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    return pd.DataFrame({"above": above, "conv_id": lows, "depth": depths, "parent_conv_id": parents, "n_convs": counts, "n_children": [len(x) for x in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})


def _built(rows: DataFrame, turns: int, limit: int) -> DataFrame:
    """rows(above, top, depth, parent, path, n, low, ends) whose tops are small -> their nodes."""
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * turns // limit))
    tail = F.slice("path", F.col("depth").cast("int"), F.size("path"))
    rows = rows.select(F.pmod(F.xxhash64("top"), F.lit(buckets)).alias("bucket"), "above", "top", "depth", "parent", F.transform(tail, lambda t: t["turn"]).alias("turns"), F.transform(tail, lambda t: t["size"]).alias("sizes"), "n", "low", "ends")
    return rows.groupBy("bucket").applyInPandas(_tries, NODES)


def _shared(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows under the large tops: those of the next round, and a row for each top with the turns that all its rows share,
    from `depth` to `to`."""
    rows = rows.join(large, ["top", "depth"])
    first, last = F.min("path"), F.max("path")  # what these two share, all between them share
    span = rows.groupBy("top", "depth").agg(first.alias("a"), last.alias("b"))
    other = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    span = span.select("top", "depth", F.when(other > 0, other - 1).otherwise(F.least(F.size("a"), F.size("b"))).cast("long").alias("to"), "a")
    span = written(span, "trie-span")
    rows = rows.join(span.drop("a"), ["top", "depth"])
    over = F.size("path") == F.col("to")
    lines = rows.groupBy("top", "depth", "to").agg(*(F.first(c).alias(c) for c in ("above", "parent", "n_convs", "conv_id")), F.max(F.when(over, F.col("ends"))).alias("ends"))
    sizes = F.transform(F.slice("a", F.col("depth").cast("int"), (F.col("to") - F.col("depth") + 1).cast("int")), lambda t: t["size"].cast("long"))
    lines = written(lines.join(span.select("top", "depth", sizes.alias("sizes")), ["top", "depth"]), "trie-line")
    step = F.element_at("path", F.col("to").cast("int") + 1)["turn"]
    below = rows.filter(~over).select(F.col("top").alias("above"), _digest(F.concat("top", step)).alias("top"), (F.col("to") + 1).alias("depth"), F.col("conv_id").alias("parent"), "path", "n", "low", "ends")
    below = written(below, "trie-rows")
    discard(span)
    return below, lines


def _lines(lines: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of the turns shared under large tops, given the tops below them."""
    below = tops.groupBy(F.col("above").alias("top")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    rows = lines.join(below, "top", "left").withColumn("at", F.explode(F.sequence("depth", "to")))
    inner, own = F.col("at") < F.col("to"), F.slice("sizes", (F.col("at") - F.col("depth") + 1).cast("int"), F.size("sizes"))
    return rows.select(
        F.when(F.col("at") == F.col("depth"), F.col("above")).alias("above"),
        "conv_id",
        F.col("at").alias("depth"),
        F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(inner, F.lit(1)).otherwise(F.coalesce("kids", F.lit(0))).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)).cast("long").alias("saved_tokens"),
        F.when(inner, F.lit(NOTHING)).otherwise(F.coalesce("ends", F.lit(NOTHING))).alias("ends_sha256"),
    )


def trie(held: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, path (as paths() has them, one row for each conversation) -> a row for each distinct beginning of a path: conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = written(distinct_paths(held), "trie-paths")
    low, n, turns = found.agg(F.min("low"), F.sum("n"), F.sum(F.size("path"))).first()
    if low is None:
        return found.select(F.lit(None).cast("binary").alias("above"), *(F.lit(None).cast("string" if c == "ends_sha256" else "long").alias(c) for c in COLUMNS)).filter("false").select(*COLUMNS)
    rows = found.filter(F.size("path") > 0).select(F.lit(ROOT).alias("above"), F.element_at("path", 1)["turn"].alias("top"), F.lit(1).cast("long").alias("depth"), F.lit(low).cast("long").alias("parent"), "path", "n", "low", "ends")
    small, rounds, temporary = [], [], [found]
    while True:
        sizes = rows.groupBy("top", "depth").agg(F.sum(F.size("path") - F.col("depth") + 1).alias("turns"), F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"))
        large = written(sizes.filter(F.col("turns") > limit).drop("turns"), "trie-large")
        temporary.append(large)
        if large.isEmpty():
            small.append(rows)
            break
        small.append(rows.join(large, ["top", "depth"], "left_anti").select(*rows.columns))
        rows, lines = _shared(rows, large)
        temporary += [rows, lines]
        rounds.append(lines)
    parts = small[0]
    for x in small[1:]:
        parts = parts.unionByName(x)
    nodes = [written(_built(parts, turns, limit), "trie-nodes")]
    for lines in reversed(rounds):
        tops = nodes[0]
        for x in nodes[1:]:
            tops = tops.unionByName(x)
        nodes.append(written(_lines(lines, tops.filter("above is not null")), "trie-nodes"))
    every = nodes[0]
    for x in nodes[1:]:
        every = every.unionByName(x)
    ends = found.filter(F.size("path") == 0).select("ends").first()
    sums = every.filter(F.col("above") == F.lit(ROOT)).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    root = [(low, 0, None, n, sums.n_children, sums.leaves or 1, sums.saved or 0, ends.ends if ends else NOTHING)]
    discard(*temporary)
    return every.select(*COLUMNS).unionByName(held.sparkSession.createDataFrame(root, NODES.removeprefix("above binary, ")))


_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
ORACLE = f"""
WITH o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, conv_id - conv_id % {SHARE} AS b, {_CRC} % {HEAD + 1} AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(o.t, [])[1:h.h], h.t[h.h + 1:]) AS t FROM h LEFT JOIN o ON o.conv_id = h.b),
p AS (SELECT conv_id, len(t) AS n, unnest(range(0, len(t) + 1)) AS depth, t FROM r),
k AS (SELECT conv_id, n, depth, t[1:depth] AS k, CASE WHEN depth > 0 THEN t[1:depth - 1] END AS up, CASE WHEN depth > 0 THEN length(t[depth].text) ELSE 0 END AS size FROM p),
g AS (SELECT k, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM k GROUP BY k),
c AS (SELECT up, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY up),
w AS (SELECT g.*, coalesce(c.n_children, 0) AS n_children FROM g LEFT JOIN c ON c.up = g.k),
a AS (SELECT k[1:d] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM w) GROUP BY 1)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN a ON a.k = w.k LEFT JOIN g u ON u.k = w.up AND w.depth > 0
"""
