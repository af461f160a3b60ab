"""Near-duplicate documents by bottom-k sketches, confirmed on whole shingle sets.

One hash function orders all shingles; a document keeps its k smallest values. Documents are linked if their sets have
Jaccard similarity of at least `similarity` percent.

1. Equal sets become one class, so copies never meet each other again. All that follows is about classes.
2. Inverted lists of retained values: of every class only the rarest half of its values is listed. Classes that share
   half of their sketches (at 0.85 fewer share so little than one pair in ten million) always meet in such a list, while
   values that very many documents hold (a common passage) stay out of it. Lists with the same members are one list.
3. Pairs come before sets: a pair is first judged by the two sketches. If these are whole sets, the answer is exact;
   else a union-sketch estimate 4.5 standard deviations below the limit ends it. What is left is tested on whole sets.
4. Stars: every class meets the smallest class of each of its lists, first the most similar of these only, and links
   are merged to components. So a group of thousands of copies needs few tests per member.
5. Lists whose members are still apart: the members outside the list's largest component meet all others of the list, in
   blocks of at most `block` against `block` members, so that a long list is many tasks. By the sketches most of them
   have no possible link and end here. The others meet once more with whole sets, or sketches of `wide` values where sets
   are larger. A member hands on its `top` most similar partners; lists in which one had more come again with eight
   times as many, after merging. No partner is left out: a list ends when all its pairs that could be links are tested
   or lie within one component.

Nulls, empty texts: an empty set, linked with nothing. Fewer words than a shingle has: the whole sequence is one shingle.
Rows are judged by themselves: rows that repeat a doc_id are linked if their own texts are, so one of them may be in a
component and another not. component_id is the smallest doc_id of a component. A null doc_id is returned with its own set
size and linked with nothing. Texts of any length count whole: a task holds the words of one text at a time. An empty table gives an
empty result. Further columns are ignored, apart from those named in `key`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fingerprint, gram_hashes, groups, hash_words, mixed, small_slices, written
from .components import connected

#: Values of a sketch and of a wide one, and members of a list that one task compares with as many others.
K, WIDE, BLOCK = 48, 512, 4096
PAIRS = "a long, b long, estimate double, sure boolean"


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text, A-Z lower-cased."""
    hashes = hash_words(text.encode().lower().split()) if text else np.empty(0, np.uint64)
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, width) if len(hashes) >= width else mixed(gram_hashes(hashes, len(hashes)) + np.uint64(len(hashes))))


def _sketches(width: int, k: int):
    """doc_id, text, further columns -> doc_id, those columns, set size, fingerprint, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, size=1_000_000):
            sets = [shingle_set(x, width) for x in batch.column("text").to_pylist()]
            one, two = zip(*map(fingerprint, sets), strict=True)
            names = [x for x in batch.schema.names if x != "text"]
            made = [pa.array([len(x) for x in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([x[:k].tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *made], names=[*names, "n_shingles", "fp1", "fp2", "sketch"])

    return run


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, sketch -> one row for each retained value."""
    for batch in small_slices(batches, 4096, column="sketch"):
        data = [np.frombuffer(x, np.int64) for x in batch.column("sketch").to_pylist()]
        lengths = [len(x) for x in data]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), lengths)), pa.array(np.repeat(np.array(lengths, np.int32), lengths)), pa.array(np.concatenate(data))], names=["node", "size", "value"])


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Similarity by the k smallest values of the union of two sketches: the share that both hold."""
    both = np.sort(np.concatenate([a, b]))
    again = np.r_[False, both[1:] == both[:-1]]
    rank = np.cumsum(~again)
    return float((again & (rank <= k)).sum() / max(1, min(k, rank[-1] if len(rank) else 1)))


class Judge:
    """What two sketches of at most k values say of two sets."""

    def __init__(self, k: int, similarity: int):
        share = similarity / 100
        self.k, self.similarity, self.floor = k, similarity, share - 4.5 * (share * (1 - share) / k) ** 0.5

    def fits(self, n: np.ndarray, m: int) -> np.ndarray:
        """Whether sizes alone allow a link."""
        return 100 * np.minimum(n, m) >= self.similarity * np.maximum(n, m)

    def __call__(self, a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[bool, float, bool]:
        """Sketches and set sizes -> whether a link is possible, the estimate, whether the link is sure."""
        if max(n, m) <= self.k:  # both sketches are whole sets
            inter = n + m - len(np.union1d(a, b))
            return 100 * inter >= self.similarity * (n + m - inter), inter / (n + m - inter), True
        estimate = union_estimate(a, b, self.k)
        return estimate >= self.floor, estimate, False

    def by_overlap(self, n: np.ndarray, m: int, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes and overlaps of sketches with one sketch -> the same three; estimates are bounds from above where they
        are not sure, as of the union's k smallest values no more than the overlap can be shared."""
        whole = (n <= self.k) & (m <= self.k)
        union = np.where(whole, n + m - overlap, self.k)
        return np.where(whole, 100 * overlap >= self.similarity * union, overlap >= self.floor * self.k), overlap / np.maximum(union, 1), whole


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    a, b, estimate, sure = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(estimate, pa.float64()), pa.array(sure, pa.bool_())], names=["a", "b", "estimate", "sure"])


def _judged(k: int, similarity: int):
    """a, b, their sizes n, m and sketches one, two -> the pairs that could be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(k, similarity)
        for batch in batches:
            out = []
            for a, b, n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "m", "one", "two")), strict=True):
                keep, estimate, sure = judge(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n, m)
                if keep:
                    out.append((a, b, estimate, sure))
            yield _pairs(out)

    return run


class Postings:
    """value -> the rows that hold it."""

    def __init__(self, rows: list[np.ndarray]):
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        order = np.argsort(flat, kind="stable")
        self.values, self.owner, self.rows = flat[order], owner[order], len(rows)

    def shared(self, values: np.ndarray) -> np.ndarray:
        """For every row, how many of these values it holds."""
        low, high = np.searchsorted(self.values, values), np.searchsorted(self.values, values, "right")
        parts = [self.owner[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True) if y > x]
        return np.bincount(np.concatenate(parts), minlength=self.rows) if parts else np.zeros(self.rows, np.int64)


class Block:
    """Members of one list that ask, and members that answer."""

    def __init__(self, value: int, rows: pa.Table, judge: Judge):
        self.value, self.judge = value, judge
        self.node, self.n, self.comp, asks = (rows.column(x).to_numpy() for x in ("node", "n", "comp", "asks"))
        self.asks, self.at = np.flatnonzero(asks), np.flatnonzero(~asks)
        self.held = [np.array(x, np.int64) for x in rows.column("held").to_pylist()]
        self.sketch = [np.frombuffer(x, np.uint64) for x in rows.column("sketch").to_pylist()]
        self.met: Postings | None = None
        if len(self.asks) and len(self.at):
            self.overlaps = Postings([self.sketch[x] for x in self.at])

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a row that asks: rows of other components that could be its links and that it meets in no list before
        this one, with estimates and whether these are sure."""
        n = self.n[self.at]
        keep, estimate, whole = self.judge.by_overlap(n, int(self.n[i]), self.overlaps.shared(self.sketch[i]))
        x = np.flatnonzero(keep & self.judge.fits(n, self.n[i]) & (self.comp[self.at] != self.comp[i]))
        if len(x):
            self.met = self.met or Postings([self.held[y] for y in self.at])
            x = x[self.met.shared(self.held[i][self.held[i] < self.value])[x] == 0]
        return self.at[x], estimate[x], whole[x]

    def marked(self) -> np.ndarray:
        """Members with a partner."""
        mark = np.zeros(len(self.node), bool)
        for i in self.asks.tolist() if len(self.at) else ():
            j, _, _ = self.partners(i)
            mark[j] = True
            mark[i] |= len(j) > 0
        return np.unique(self.node[mark])

    def best(self, top: int) -> Iterator[tuple | None]:
        """Of each member that asks the `top` most similar partners; None if there were more."""
        for i in self.asks.tolist() if len(self.at) else ():
            j, estimate, whole = self.partners(i)
            taken = 0
            for x in np.lexsort((self.node[j], -estimate)).tolist():
                keep, share = True, float(estimate[x])
                if not whole[x]:
                    keep, share, _ = self.judge(self.sketch[i], self.sketch[j[x]], int(self.n[i]), int(self.n[j[x]]))
                if keep and taken == top:
                    yield None
                    break
                if keep:
                    taken += 1
                    yield (*sorted((int(self.node[i]), int(self.node[j[x]]))), share, bool(whole[x]))


def _blocks_of(batches: Iterator[pa.RecordBatch], judge: Judge) -> Iterator[Block]:
    for (value, *_), parts in groups(batches, ["value", "part", "other"]):
        yield Block(int(value), pa.Table.from_batches(parts), judge)


def _mark(k: int, similarity: int):
    """Rows sorted by value, part, other -> members (value, node) that could have links in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches, Judge(k, similarity)):
            nodes = block.marked()
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.repeat(block.value, len(nodes)), pa.array(nodes)], names=["value", "node"])

    return run


def _round(k: int, similarity: int, top: int):
    """Rows sorted by value, part, other -> pairs; for a list that is not done, a row (value, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = set()
        for block in _blocks_of(batches, Judge(k, similarity)):
            out |= {(block.value, None, 0.0, False) if x is None else x for x in block.best(top)}
            if len(out) > 10_000:
                yield _pairs(list(out))
                out = set()
        if out:
            yield _pairs(list(out))

    return run


def _sets(width: int):
    """Rows of a class's doc_id -> its whole set, from those whose text has the class's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, size=1_000_000):
            nodes, sets = [], []
            for node, text, one, two in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "fp1", "fp2")), strict=True):
                values = shingle_set(text, width)
                if fingerprint(values) == (one, two):
                    nodes.append(node)
                    sets.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "values"])

    return run


def _confirm(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 512, column="one"):
            a, b, keep = batch.column("one").to_pylist(), batch.column("two").to_pylist(), []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class Links:
    """Components of classes, as pairs come to be tested."""

    def __init__(self, docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int, similarity: int):
        self.docs, self.classes, self.width, self.similarity = docs, classes, width, similarity
        self.comps = written(nodes.select("node", F.col("node").alias("comp")), "comps", narrow=True)
        self.sets: DataFrame | None = None

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends lie in different components, with these as x and y."""
        ends = [self.comps.select(F.col("node").alias(n), F.col("comp").alias(c)) for n, c in (("a", "x"), ("b", "y"))]
        return pairs.join(ends[0], "a").join(ends[1], "b").filter("x <> y")

    def whole(self, need: DataFrame) -> DataFrame:
        """Whole sets of classes (and others); those read before are not read again."""
        need = need.select("node").distinct()
        if self.sets is not None:
            need = need.join(self.sets.select("node"), "node", "left_anti")
        need = need.join(self.classes.select("node", "doc_id", "fp1", "fp2"), "node")
        texts = self.docs.select("doc_id", "text").join(need, "doc_id").select("node", "text", "fp1", "fp2")
        # A doc_id may be repeated with the same text.
        more = written(texts.mapInArrow(_sets(self.width), "node long, values binary").groupBy("node").agg(F.first("values").alias("values")), "sets")
        self.sets = more if self.sets is None else self.sets.unionByName(more)
        return self.sets

    def test(self, pairs: DataFrame) -> None:
        """Tests pairs whose ends are apart and merges what is linked."""
        pairs = written(self.apart(pairs), "apart", narrow=True)
        if not pairs.limit(1).count():
            discard(pairs)
            return
        links, unsure = pairs.filter("sure").select("a", "b"), pairs.filter("not sure").select("a", "b")
        if unsure.limit(1).count():
            whole = self.whole(unsure.select(F.col("a").alias("node")).union(unsure.select(F.col("b").alias("node"))))
            two = unsure.join(whole.select(F.col("node").alias("b"), F.col("values").alias("two")), "b")
            both = two.join(whole.select(F.col("node").alias("a"), F.col("values").alias("one")), "a").select("a", "b", "one", "two")
            links = links.union(both.mapInArrow(_confirm(self.similarity), "a long, b long"))
        edges = written(pairs.join(links, ["a", "b"], "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges", narrow=True)
        if edges.limit(1).count():
            labels = connected(edges)
            before, self.comps = self.comps, written(self.comps.join(labels.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("label", "comp").alias("comp")), "comps", narrow=True)
            discard(before, labels)
        discard(pairs, edges)


def _listed(classes: DataFrame) -> DataFrame:
    """classes(node, sketch) -> value, node: the inverted lists."""
    values = classes.select("node", "sketch").mapInArrow(_values, "node long, size int, value long")
    # Written first, as a hot value's side of a join can be split only where the other side is not still being added up.
    often = written(values.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1"), "often", narrow=True)
    shared = values.join(often, "value").groupBy("node").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("often", "value"))).alias("held"))
    # The rarest half of the sketch and one more; values that only one class holds are the rarest of all.
    room = F.greatest(F.lit(0), F.floor(F.col("size") / 2).cast("int") + 1 - (F.col("size") - F.size("held")))
    listed = written(shared.select("node", F.explode(F.slice("held", F.lit(1), room)).alias("x")).select("node", F.col("x.value").alias("value")), "listed", narrow=True)
    members = listed.groupBy("value").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h")).filter("c > 1")
    one_each = written(members.groupBy("c", "h").agg(F.min("value").alias("value")).select("value"), "values", narrow=True)
    lists = written(listed.join(one_each, "value").select("value", "node"), "lists")
    discard(often, listed, one_each)
    return lists


def _blocks(at: DataFrame, block: int) -> DataFrame:
    """at(value, node, comp) of lists whose members are apart -> value, part, other, asks, node, comp: members outside
    the list's largest component ask those of part `other`."""
    sizes = at.groupBy("value", "comp").agg(F.count("*").alias("c")).groupBy("value").agg(F.sum("c").alias("members"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"))
    # Of two members one is the star's centre.
    sizes = sizes.filter("most < members and members > 2")
    share = lambda n: F.ceil(n / block).cast("long")
    rows = at.join(sizes, "value").withColumns({"parts": share(F.col("members") - F.col("most")), "others": share(F.col("members"))})
    own = {"part": F.pmod(F.xxhash64("node"), F.col("parts")), "other": F.pmod(F.xxhash64("node", F.lit(1)), F.col("others"))}
    outside = rows.filter("comp <> main")
    asking = outside.withColumn("part", own["part"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))).withColumn("asks", F.lit(True))
    answering = rows.withColumn("other", own["other"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("asks", F.lit(False))
    return asking.unionByName(answering).select("value", "part", "other", "asks", "node", "comp")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 85, k: int = K, wide: int = WIDE, block: int = BLOCK, top: int = 4, key: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept; one row for each input row.

    With `key`, columns that name a row: these are returned as well, and `first`: whether the row is the one of its
    component with the smallest doc_id and then key, or is linked with nothing."""
    if k < 8 or wide < k or not 80 <= similarity <= 100 or block < 1 or top < 1:
        raise ValueError("k of at least 8 and at most wide, a similarity of 80 to 100 percent, and positive block and top are supported")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    table = written(docs.mapInArrow(_sketches(width, k), f"{fields}, n_shingles long, fp1 long, fp2 long, sketch binary"), "sketches")
    full = table.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("doc_id", *key)).alias("rep"), F.first("sketch").alias("sketch"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "fp1", "fp2", F.col("n_shingles").alias("n"), "rep", F.col("rep.doc_id").alias("doc_id"), "sketch"), "classes")

    lists = _listed(classes)
    links = Links(docs, classes, lists.select("node").distinct(), width, similarity)
    sketch = classes.select("node", "n", "sketch")
    # Stars.
    sized = lists.join(sketch.select("node", "n"), "node")
    centre = written(sized.groupBy("value").agg(F.min(F.struct("node", "n")).alias("c")), "centres", narrow=True)
    star = sized.join(centre, "value").filter("node <> c.node").filter(f"100 * least(n, c.n) >= {similarity} * greatest(n, c.n)").select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(sketch.toDF("b", "m", "two"), "b").join(sketch.toDF("a", "n", "one"), "a").select("a", "b", "n", "m", "one", "two")
    tested = [written(star.mapInArrow(_judged(k, similarity), PAIRS), "stars", narrow=True)]
    best = tested[0].groupBy("b").agg(F.max_by(F.struct("a", "estimate", "sure"), F.struct("estimate", -F.col("a"))).alias("best"))
    best = written(best.select("best.a", "b", "best.estimate", "best.sure"), "best", narrow=True)
    links.test(best)
    links.test(tested[0].join(best, ["a", "b"], "left_anti"))
    discard(best, centre)
    # Lists still apart: first which members could have a link at all, then whole sets of these or wide sketches.
    def asked(lists: DataFrame, held: DataFrame, sketch: DataFrame) -> DataFrame:
        rows = _blocks(lists.join(links.comps, "node"), block).join(sketch, "node").join(held, "node")
        return rows.select("value", "part", "other", "asks", "node", "n", "comp", "held", "sketch").repartition("value", "part", "other").sortWithinPartitions("value", "part", "other")

    held = lambda lists: lists.groupBy("node").agg(F.sort_array(F.collect_list("value")).alias("held"))
    marked = written(asked(lists, held(lists), sketch).mapInArrow(_mark(k, similarity), "value long, node long").distinct(), "marked", narrow=True)
    discard(lists)
    if marked.limit(1).count():
        broad = links.whole(marked).select("node", F.substring("values", 1, 8 * wide).alias("sketch")).join(sketch.select("node", "n"), "node")
        todo = marked
        while True:
            found = written(asked(todo, held(marked), broad).mapInArrow(_round(wide, similarity, top), PAIRS), "found", narrow=True)
            pairs = found.filter("b is not null").dropDuplicates(["a", "b"])
            for before in tested:
                pairs = pairs.join(before.filter("not sure").select("a", "b"), ["a", "b"], "left_anti")
            tested.append(written(pairs, "pairs", narrow=True))
            links.test(tested[-1])
            more = written(found.filter("b is null").select(F.col("a").alias("value")).distinct(), "more", narrow=True)
            if not more.limit(1).count():
                break
            before, todo = todo, written(marked.join(more, "value", "left_semi"), "todo", narrow=True)
            discard(found, more, *([] if before is marked else [before]))
            top *= 8
        discard(found, more, todo)
    discard(marked, *tested)

    named = classes.join(links.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    named = named.join(least, "comp").select("fp1", "fp2", F.col("n").alias("n_shingles"), "least")
    found = table.drop("sketch").join(named, ["fp1", "fp2", "n_shingles"], "left")
    # An empty set has no class; a null doc_id may have the class of others but stays by itself.
    linked = F.col("least").isNotNull() & F.col("doc_id").isNotNull()
    found = found.select("doc_id", *key, "n_shingles", F.when(linked, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), *([(~linked | (F.col("least") == F.struct("doc_id", *key))).alias("first")] if key else []))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The same rows in SQL, for tables small enough to join all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT m.b, r.low FROM r JOIN both_ways m ON m.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.low) AS component_id, d.doc_id = min(r.low) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""
