"""Documents that hold benchmark items, also in another order of passages, by greedy string tiling.

Words are runs without white space, A-Z lower-cased, without punctuation at either end. Documents that share a seed (`least` words
in a row) with an item are tiled against it: the longest common run that is still free on both sides is marked first
(lengths come from Karp-Rabin hashes), then shorter ones down to `least` words. An item is contained if the
marked words are at least `coverage` of it. Work grows with the number of common runs, also where texts repeat one word.

The benchmark is a fixed query set. Its size is checked; it is sent to the tasks in blocks of at most BLOCK_CHARS
characters, each run over all documents, so a large one takes more passes and never more memory.

Null, empty and shorter documents than `least` words hold nothing; texts of any length are tiled whole. Nothing is found with an empty benchmark, and no row of an empty table. Items with fewer than `least` words (null and empty
ones as well) are never found. Items with equal texts are reported each. Rows with a null doc_id are reported with it.
Repeated doc_ids are reported row by row. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gram_hashes, hold_caches, small_slices, written
from .periodic_runs import Prefixes, farthest

LEAST, COVERAGE, BLOCK_CHARS = 5, 0.5, 16_000_000
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOW = np.uint64((1 << 20) - 1)


def plain_hashes(text: str | None) -> np.ndarray:
    """Hashes, never 0, of a text's words without punctuation at their ends; words that are nothing else go."""
    plain = filter(None, map(bytes.strip, text.encode().lower().split(), repeat(_EDGES))) if text else ()
    return np.maximum(np.array(list(map(xxhash.xxh3_64_intdigest, plain)), np.uint64), np.uint64(1))


def _products(item: np.ndarray, text: np.ndarray, least: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the item, in the text) where a common run of `least` words or more begins: seeds that are equal, with unequal words
    before them. Seeds with the same word before them are met as a group, so repeats make no more pairs than there are such runs."""
    own = gram_hashes(item, least)
    places = np.flatnonzero(np.isin(grams, own))
    before_item = np.concatenate([[np.uint64(2**64 - 1)], item])[: len(own)]
    before_text = np.concatenate([[np.uint64(2**64 - 2)], text])[places]
    order = np.lexsort((before_item, own))
    cuts = np.flatnonzero((own[order][1:] != own[order][:-1]) | (before_item[order][1:] != before_item[order][:-1])) + 1
    by_gram = places[np.argsort(grams[places], kind="stable")]
    before_text = before_text[np.argsort(grams[places], kind="stable")]
    sorted_grams = grams[by_gram]
    first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for group in np.split(order, cuts):
        low, high = np.searchsorted(sorted_grams, own[group[0]]), np.searchsorted(sorted_grams, own[group[0]], "right")
        begin = by_gram[low:high][before_text[low:high] != before_item[group[0]]]
        if len(begin):
            first.append(np.repeat(group, len(begin)))
            second.append(np.tile(begin, len(group)))
    return np.concatenate(first), np.concatenate(second)


def tiles(item: list | np.ndarray, text: list | np.ndarray, least: int = LEAST, grams: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, words) in the order of their marking: longest first, then by place in the item, then in the
    text. item and text are word numbers; grams: the seeds of the text, if known. Each common run is found once with its whole length, by binary search over
    Karp-Rabin hashes. One that is partly taken when its turn comes goes back with what is left of it, so the longest free run is always next."""
    item, text = np.asarray(item, np.uint64), np.asarray(text, np.uint64)
    grams = gram_hashes(text, least) if grams is None else grams
    if len(item) < least or len(text) < least:
        return []
    i, j = _products(item, text, least, grams)
    if not len(i):
        return []
    hashes = Prefixes(np.concatenate([item, text]))
    n = farthest(lambda m: hashes.same(i, len(item) + j - i, m), np.minimum(len(item) - i, len(text) - j))
    heap = list(zip((-n).tolist(), i.tolist(), j.tolist(), strict=True))
    heapq.heapify(heap)
    free_item, free_text, left, out = np.ones(len(item), bool), np.ones(len(text), bool), len(item), []
    while heap and left >= least:
        n, i, j = heapq.heappop(heap)
        n = -n
        good = free_item[i : i + n] & free_text[j : j + n] & (item[i : i + n] == text[j : j + n])
        if good.all():
            free_item[i : i + n] = free_text[j : j + n] = False
            left -= n
            out.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def covered(item: np.ndarray, text: np.ndarray, least: int, grams: np.ndarray) -> int:
    """Words of the item in tiles."""
    return sum(n for _, _, n in tiles(item, text, least, grams))


class Items:
    """Items of a block and the seeds that lead to them."""

    def __init__(self, items: list[tuple[int, str]], least: int, coverage: float):
        self.least, self.coverage = least, coverage
        hashed = [(i, plain_hashes(t)) for i, t in items]
        self.items = [(i, h) for i, h in hashed if len(h) >= least]
        self.grams = [gram_hashes(h, least) for _, h in self.items]
        self.repeat = [len(np.unique(g)) < len(g) for g in self.grams]
        seed = np.concatenate(self.grams) if self.grams else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(self.grams)), [len(g) for g in self.grams])
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner = seed[order], owner[order]
        self.likely = np.zeros(1 << 20, bool)  # most words of most documents end here
        self.likely[seed & _LOW] = True

    def held(self, text: str | None) -> list[tuple[int, float]]:
        """(item_id, coverage) of the items that a text holds."""
        words = plain_hashes(text)
        grams = gram_hashes(words, self.least)
        own = np.unique(grams[self.likely[grams & _LOW]])
        if not len(own) or not len(self.seed):
            return []
        low, high = np.searchsorted(self.seed, own), np.searchsorted(self.seed, own, "right")
        hits = np.flatnonzero(high > low)
        if not len(hits):
            return []
        shared = np.bincount(np.concatenate([self.owner[low[k] : high[k]] for k in hits]), minlength=len(self.items))
        out = []
        for k in np.flatnonzero(shared).tolist():
            item, hashes = self.items[k]
            # s shared seeds can mark s * least words at most
            if int(shared[k]) * self.least >= self.coverage * len(hashes) or self.repeat[k]:
                share = covered(hashes, words, self.least, grams) / len(hashes)
                if share >= self.coverage:
                    out.append((item, round(share, 6)))
        return out


def _contained(items: list[tuple[int, str]], least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("plain words", None)
        known = Items(items, least, coverage)
        for batch in small_slices(batches):
            rows = [(doc, *x) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in known.held(text)]
            docs, found, shares = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "item_id", "coverage"])

    return run


def _without(items: list[tuple[int, str]], least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("plain words", None)
        known = Items(items, least, coverage)
        for batch in small_slices(batches):
            yield batch.filter(pa.array([not known.held(x) for x in batch.column("text").to_pylist()], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Blocks of items of at most BLOCK_CHARS characters or so, one at a time, and whether more follow."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        yield [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()], b < blocks - 1


def _check(least: int, coverage: float) -> None:
    if least < 2 or not 0 < coverage <= 1:
        raise ValueError("seeds of two words or more and a coverage above 0 up to 1 are supported")


def contained_items(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, coverage: one row for each contained item."""
    _check(least, coverage)
    docs, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None
    for block, more in _blocks(benchmark):
        rows = docs.mapInArrow(_contained(block, least, coverage), "doc_id long, item_id long, coverage double")
        if more:  # so that one block's items are held at a time
            rows = written(rows, "contained")
        out = rows if out is None else out.unionAll(rows)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """Rows of docs(text, ...) that hold no item, with all their columns; each row is judged by its own text, in one
    pass and without a shuffle."""
    _check(least, coverage)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    for block, more in _blocks(benchmark):
        before, docs = docs, docs.mapInArrow(_without(block, least, coverage), docs.schema)
        if more:
            docs = written(docs, "without-items")
            discard(before)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document that holds an item: doc_id, item_ids (ascending), coverage (the highest). Rows that
    repeat a doc_id make one row."""
    rows = contained_items(docs, benchmark, least, coverage)
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))
