"""Removal of long passages that start in a document with a smaller id, by prefix-partitioned suffix trees over words.

A window is `window` consecutive words. Every word covered by a window that also starts in a smaller document goes.

1. Documents with equal word sequences become one class; a later copy of at least `window` words goes as a whole.
2. Variable-length prefixes deal out the suffixes that start at windows. A window goes by the lowest-hashed run of PREFIXES[0] words inside
   it (the leftmost one), which equal windows share, so that consecutive windows mostly go together, as one stretch of
   text. Equal stretches are one: a stretch that a smaller document holds goes as a whole, and only the first one's text
   is ever sent. Runs that only one document holds end here. A run whose distinct stretches have more than `group_words` words is too large
   for one tree: its windows go by longer runs (PREFIXES[1] words, and so on), and at last by all their words, where
   equal windows are one stretch and need no tree. So no group outgrows a task, however many documents share a run.
3. Each group of stretches gives a subtree of the suffix tree: suffixes sorted by rank doubling, with the lengths of the prefixes that
   neighbours have in common. Its internal nodes at depth `window` or more are the repeats: a node's depth is the length of a
   repeat that can't be longer to the right, its leaves are where it occurs. Leaves of documents above the node's
   smallest one lose that many words. Nodes below such a node need no look: what they cover beyond it are windows that
   are leaves themselves.

Null or empty texts have no words and stay. Rows that repeat a doc_id are each judged by their own text, against smaller
doc_ids only. A row with a null doc_id is compared with nothing and keeps its words. Texts of any length are read whole, one at a
time. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULTIPLIER, discard, fingerprint, free_name, gram_hashes, hash_words, mixed, small_slices, words_of, written

#: Lengths of prefixes, in words, before a whole window.
PREFIXES = (8, 32)
#: Most words of distinct stretches in one group, and words at which a task builds the subtrees of the groups it has.
GROUP_WORDS, TREE_WORDS = 200_000, 300_000
#: Most stretches or ranges that go to all tasks (at most 32 bytes each), in place of a shuffle of all texts.
FEW = 100_000
STRETCH = "run long, h long, first int, windows int"
_ITEMS = pa.list_(pa.struct([("run", pa.int64()), ("h", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())]))


def anchors(hashes: np.ndarray, window: int, length: int) -> np.ndarray:
    """For each window start, the position of its lowest-hashed run of so many words."""
    grams = gram_hashes(hashes, length)
    wide = window - length + 1
    if len(grams) < wide:
        return np.empty(0, np.int64)
    view = sliding_window_view(grams, wide)
    return np.concatenate([view[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, len(view))) for i in range(0, len(view), 65536)])


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words from start to end."""
    n = len(hashes)
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, MULTIPLIER, np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)], dtype=np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(mixed(hashes) * up[:n], dtype=np.uint64)]
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * MULTIPLIER)


def stretches(hashes: np.ndarray, window: int, length: int, within: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, ...]:
    """Runs, stretch hashes, first windows and window counts of a document's stretches; of windows in ranges (first,
    windows) alone, if given."""
    at = anchors(hashes, window, length)
    starts = np.arange(len(at)) if within is None else np.unique(np.concatenate([np.arange(f, f + w) for f, w in within]))
    if not len(starts):
        return (np.empty(0, np.int64),) * 4
    cuts = np.flatnonzero((np.diff(at[starts]) != 0) | (np.diff(starts) != 1)) + 1
    first, count = starts[np.r_[0, cuts]], np.diff(np.r_[0, cuts, len(starts)])
    run = gram_hashes(hashes, length)[at[first]]
    return run.view(np.int64), span_hashes(hashes, first, first + count + window - 1).view(np.int64), first, count


def _profile(window: int):
    """doc_id, th, text -> doc_id, th, word count, sequence fingerprint, digest of all words, stretches by the shortest prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            counts, one, two, digests, ends, parts = [], [], [], [], [0], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                hashes = hash_words(words)
                a, b = fingerprint(hashes)
                parts.append(stretches(hashes, window, PREFIXES[0]))
                for col, x in zip((counts, one, two, digests, ends), (len(words), a, b, hashlib.sha256(b" ".join(words)).digest(), ends[-1] + len(parts[-1][0])), strict=True):
                    col.append(x)
            columns = [np.concatenate([p[c] for p in parts]).astype(t) for c, t in enumerate((np.int64, np.int64, np.int32, np.int32))]
            items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_ITEMS.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(counts, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(digests, pa.binary()), items], names=["doc_id", "th", "n_words", "fp1", "fp2", "digest", "items"])

    return run


def _longer(window: int, length: int):
    """doc_id, th, text, ranges of windows -> their stretches by runs of so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            for doc, th, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "ranges")), strict=True):
                found = stretches(hash_words(words_of(text)), window, length, [(r["first"], r["windows"]) for r in ranges])
                columns = [pa.array(c.astype(t)) for c, t in zip(found, (np.int64, np.int64, np.int32, np.int32), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.repeat(doc, len(found[0])), pa.repeat(th, len(found[0])), *columns], names=["doc_id", "th", "run", "h", "first", "windows"])

    return run


def _send(window: int):
    """doc_id, text, items -> run, h, doc_id, windows, words of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 64):
            out: list[tuple] = []
            for doc, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items")), strict=True):
                words = words_of(text)
                out += [(x["run"], x["h"], doc, x["windows"], b" ".join(words[x["first"] : x["first"] + x["windows"] + window - 1])) for x in items]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "h", "doc_id", "windows", "words"])

    return run


class Subtree:
    """The suffix tree over some stretches of words, as its leaves in order and the depth at which neighbours part."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        """words: numbers of all stretches' words, one after another; sizes: words of each stretch."""
        # Every stretch ends with a number of its own, so that no repeat runs over an end.
        ends = np.cumsum(sizes + 1) - 1
        text = np.empty(len(words) + len(sizes), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside], text[ends] = words, words.max(initial=0) + 1 + np.arange(len(sizes))
        self.begin = ends - sizes
        ranks, depth = [np.unique(text, return_inverse=True)[1]], 1
        while depth <= sizes.max(initial=0):
            rank, ahead = ranks[-1], np.zeros(len(text), np.int64)
            ahead[: max(0, len(text) - depth)] = rank[depth:] + 1
            ranks.append(np.unique(rank * (len(text) + 1) + ahead, return_inverse=True)[1])
            depth *= 2
        self.ranks = ranks

    def leaves(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes at these places in order, and the length of the prefix that each has in common with the one before."""
        order = places[np.argsort(self.ranks[-1][places], kind="stable")]
        a, b = order[:-1].copy(), order[1:].copy()
        common, last = np.zeros(len(a), np.int64), len(self.ranks[0]) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[k][np.minimum(a, last)] == self.ranks[k][np.minimum(b, last)]
            same &= (a <= last) & (b <= last)
            step = same * (1 << k)
            common, a, b = common + step, a + step, b + step
        return order, np.r_[0, common]


def deep_nodes(common: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The uppermost internal nodes at depth `window` or more: first leaf, leaf after the last one, depth."""
    deep = common >= window
    first = np.flatnonzero(deep & ~np.r_[False, deep[:-1]]) - 1
    last = np.flatnonzero(deep & ~np.r_[deep[1:], False]) + 1
    edges = np.stack([first + 1, last], axis=1).ravel()
    return first, last, np.minimum.reduceat(np.r_[common, 0], edges)[::2] if len(edges) else edges


def _covered(rows: list[tuple], window: int) -> list[tuple]:
    """Stretches (run, h, doc, windows, words) -> (run, h, doc, first, windows): what smaller documents hold as well."""
    number: dict[bytes, int] = {}
    lists = [x[4].split() for x in rows]
    tree = Subtree(np.array([number.setdefault(w, len(number)) for x in lists for w in x], np.int64), np.array([len(x) for x in lists]))
    counts = np.array([x[3] for x in rows])
    owner = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = tree.begin[owner] + offset
    order, common = tree.leaves(places)
    first, last, depth = deep_nodes(common, window)
    if not len(first):
        return []
    leaf = np.empty(len(tree.ranks[0]), np.int64)  # place -> its number among all windows
    leaf[places] = np.arange(len(places))
    at = leaf[order]
    doc = np.array([x[2] for x in rows], np.int64)[owner[at]]
    size = last - first
    inside = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    node = np.repeat(np.arange(len(first)), size)
    least = np.minimum.reduceat(doc[inside], np.r_[0, np.cumsum(size)[:-1]])
    hit = least[node] < doc[inside]
    windows = np.zeros(len(owner) + 1, np.int64)
    begins, long = at[inside][hit], (depth[node] - window + 1)[hit]
    np.add.at(windows, begins, 1)
    # A repeat ends within its stretch, but its windows are counted in that stretch only.
    np.add.at(windows, np.minimum(begins + long, np.cumsum(counts)[owner[begins]]), -1)
    marked = np.cumsum(windows[:-1]) > 0
    edges = np.flatnonzero(marked)
    breaks = np.flatnonzero((np.diff(edges) > 1) | (owner[edges[1:]] != owner[edges[:-1]])) + 1
    out = []
    for a, b in zip(np.r_[0, breaks].tolist(), np.r_[breaks, len(edges)].tolist(), strict=True):
        if b > a:
            run, h, d, *_ = rows[owner[edges[a]]]
            out.append((run, h, d, int(offset[edges[a]]), b - a))
    return out


def _trees(window: int, limit: int):
    """Rows sorted by run -> what smaller documents hold; whole groups are taken until they have enough words."""
    names = ["run", "h", "doc_id", "offset", "covered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def tree() -> Iterator[pa.RecordBatch]:
            found = _covered(held, window) if held else []
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("run", "h", "doc_id", "windows", "words")), strict=True):
                if size >= limit and row[0] != held[-1][0]:
                    yield from tree()
                    held, size = [], 0
                held.append(row)
                size += row[3] + window
        yield from tree()

    return run


def _left(text: str | None, ranges: list[dict], window: int) -> tuple[int, int, bytes]:
    """Words of a text, how many of them the ranges of windows cover, and the others joined by one space."""
    words = words_of(text)
    gone = np.zeros(len(words) + 1, np.int32)
    for r in ranges:
        gone[r["first"]] += 1
        gone[min(len(words), r["first"] + r["windows"] + window - 1)] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def _digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 128):
            cols: list[list] = [[], [], []]
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                n, removed, left = _left(text, ranges, window)
                for col, x in zip(cols, (n, removed, hashlib.sha256(left).hexdigest()), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _cut(window: int, name: str):
    """Rows with their text and, last, the ranges to remove -> rows with the kept text and whether anything went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 128):
            at, ranges = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1)
            columns, hit = batch.columns[:-1], ranges.is_valid()
            if ranges.null_count < batch.num_rows:
                pairs = zip(columns[at].to_pylist(), ranges.to_pylist(), strict=True)
                columns[at] = pa.array([_left(t, r, window)[2].decode() if r else t for t, r in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, hit], names=[*batch.schema.names[:-1], name])

    return run


def _texts(docs: DataFrame, wanted: DataFrame, items: str, longer: bool) -> DataFrame:
    """Texts of the documents in wanted(doc_id, th, items), a table, each once even where rows repeat. By the shortest prefixes most documents
    are wanted; longer ones seldom concern many, and few wanted ones are sent to the texts."""
    few = longer and (wanted.agg(F.sum(F.size(items))).first()[0] or 0) <= FEW
    return docs.join(F.broadcast(wanted) if few else wanted, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])


def _level(docs: DataFrame, found: DataFrame, window: int, group_words: int, tree_words: int, longer: bool) -> tuple[list[DataFrame], DataFrame]:
    """found(doc_id, th, run, h, first, windows): stretches of one prefix length -> tables of ranges (doc_id, th, first,
    windows) to remove, and stretches of first documents whose run's group is too large."""
    # Runs of one document alone are of no use.
    shared = found.groupBy("run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("run")
    # Written first, as a hot run's side of a join can be split only where the other side is not still being added up.
    shared = written(shared, "runs", narrow=True)
    found = written(found.join(shared, "run"), "shared")
    discard(shared)
    first = found.groupBy("run", "h").agg(F.min(F.struct("doc_id", "th", "first")).alias("rep"), F.max("doc_id").alias("high"), F.first("windows").alias("windows"))
    first = written(first, "first", narrow=True)
    copies = found.join(first.filter("rep.doc_id < high").select("run", "h", F.col("rep.doc_id").alias("low")), ["run", "h"]).filter("low < doc_id")
    whole = written(copies.select("doc_id", "th", "first", "windows").distinct(), "whole", narrow=True)
    sizes = first.groupBy("run").agg(F.min("rep.doc_id").alias("low"), F.max("rep.doc_id").alias("high"), F.sum(F.col("windows") + window - 1).alias("words")).filter("low < high")
    sizes = written(sizes.select("run", (F.col("words") > group_words).alias("large")), "sizes", narrow=True)
    one_tree = first.join(sizes.filter("not large").select("run"), "run")
    wanted = written(one_tree.groupBy("rep.doc_id", "rep.th").agg(F.collect_list(F.struct("run", "h", F.col("rep.first").alias("first"), "windows")).alias("items")), "wanted", narrow=True)
    sent = _texts(docs, wanted, "items", longer).mapInArrow(_send(window), "run long, h long, doc_id long, windows int, words binary")
    trees = written(sent.repartition("run").sortWithinPartitions("run").mapInArrow(_trees(window, tree_words), "run long, h long, doc_id long, offset int, covered int"), "trees", narrow=True)
    # A document may hold its stretch more than once.
    inner = trees.join(found, ["run", "h", "doc_id"]).select("doc_id", "th", (F.col("first") + F.col("offset")).alias("first"), F.col("covered").alias("windows"))
    inner = written(inner.distinct(), "inner", narrow=True)
    large = first.join(sizes.filter("large").select("run"), "run").select("run", "h", F.col("rep.doc_id").alias("doc_id"))
    large = written(large.join(found, ["run", "h", "doc_id"]).select("doc_id", "th", "first", "windows"), "large", narrow=True)
    discard(found, first, sizes, trees, wanted)
    return [whole, inner], large


def _repeats(docs: DataFrame, window: int, group_words: int, tree_words: int) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, th, text), th a hash of the text -> a profile of each row; and doc_id, th, ranges of windows to remove."""
    if window <= PREFIXES[0]:
        raise ValueError(f"a window needs at least {PREFIXES[0] + 1} words")
    profile = written(docs.mapInArrow(_profile(window), f"doc_id long, th long, n_words long, fp1 long, fp2 long, digest binary, items array<struct<{STRETCH.replace(' long', ':long').replace(' int', ':int')}>>"), "profile")
    long = profile.filter(f"n_words >= {window} and doc_id is not null")
    firsts = written(long.groupBy("fp1", "fp2", "n_words").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("items").alias("items")), "firsts")
    found = written(firsts.select("rep.doc_id", "rep.th", F.inline("items")), "stretches")
    members = long.drop("items").join(firsts.drop("items"), ["fp1", "fp2", "n_words"])
    copies = written(members.filter("rep.doc_id < doc_id").select("doc_id", "th", F.lit(0).alias("first"), F.col("n_words").cast("int").alias("windows")).distinct(), "copies")
    # Rows of a first document whose text differs in white space alone share its words, but not its hash.
    same = written(members.filter("rep.doc_id = doc_id and rep.th <> th").select("doc_id", "th", F.col("rep.th").alias("rep")).distinct(), "same")
    ranges, longer = [copies], False
    for length in [*(x for x in PREFIXES[1:] if x < window), window]:
        tables, large = _level(docs, found, window, group_words, tree_words, longer)
        ranges += tables
        discard(found)
        if not large.limit(1).count():
            break
        longer = True
        wanted = written(large.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "windows")).alias("ranges")), "wanted", narrow=True)
        found = written(_texts(docs, wanted, "ranges", longer).mapInArrow(_longer(window, length), f"doc_id long, th long, {STRETCH}"), "stretches")
        discard(large, wanted)
    else:
        # Every group is one window now.
        ranges += _level(docs, found, window, group_words, tree_words, longer)[0]
    discard(large, firsts)
    gone = ranges[0]
    for table in ranges[1:]:
        gone = gone.unionByName(table)
    gone = gone.unionByName(gone.join(same.withColumnRenamed("th", "other").withColumnRenamed("rep", "th"), ["doc_id", "th"]).select("doc_id", F.col("other").alias("th"), "first", "windows"))
    return profile, gone.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "windows")).alias("ranges"))


def _typed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})


def repeated_passages(docs: DataFrame, window: int = 50, group_words: int = GROUP_WORDS, tree_words: int = TREE_WORDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    docs = _typed(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    profile, gone = _repeats(docs, window, group_words, tree_words)
    cut = docs.join(gone, ["doc_id", "th"]).mapInArrow(_digests(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    same = profile.join(gone, ["doc_id", "th"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("digest")).alias("kept_sha256"))
    return cut.unionByName(same)


def without_passages(docs: DataFrame, window: int = 50, group_words: int = GROUP_WORDS, tree_words: int = TREE_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) -> the same rows with the kept words, joined by one space, as text where words went, and
    last a boolean column that says where (words_removed; underscores follow if there is such a column). Texts move
    once, with their row."""
    docs = _typed(docs)
    profile, gone = _repeats(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), window, group_words, tree_words)
    discard(profile)
    th, ranges, cut = (free_name(docs.columns, x) for x in ("text_hash", "ranges", "words_removed"))
    rows = docs.withColumn(th, F.xxhash64("text")).join(gone.withColumnsRenamed({"th": th, "ranges": ranges}), ["doc_id", th], "left").select(*docs.columns, ranges)
    return rows.mapInArrow(_cut(window, cut), T.StructType([*docs.schema.fields, T.StructField(cut, T.BooleanType())]))


#: The same rows in SQL; it writes every window out, so it suits small tables.
ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM hit, range(0, 50) t(o)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN left_over l ON l.doc_id = w.doc_id
"""
