"""Stretches of words that repeat with a period, found in each text, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(SHORTEST, TIMES * q) words that no word beside it prolongs with that period. Words i and i + q are equal all along a
run but for its last q words, so every max(SHORTEST, TIMES * q) - q words one of them lies on a grid point of q: the
grids of all periods together have about n ln n / 3 points. For all (period, point) pairs of a text at once NumPy first compares the words
there and those beside them, then hashes of half a grid step to each side, taken from prefix hashes modulo two primes, which leaves
few pairs; binary searches tell how far these stay equal to the right and to the left, all at a time. Equal hashes may hide a difference, never the
reverse, so the words of each run are compared at last; if any differ, that text is searched word by word. A run is found with
multiples of its period too, at the same place: the smallest counts.

Each text is worked out by itself, whole: no shuffle, no key. Pairs are built PAIRS at a time, so memory grows with the words
alone. Null, empty and short texts have no run. Null doc_ids stay null, rows that repeat stay apart; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, hold_caches, mixed, small_slices, words_of

SHORTEST, TIMES, PAIRS = 6, 4, 1 << 20
#: Modulus and base of each prefix hash.
HASHES = ((2147483647, 1_103_515_245), (2147483629, 1_664_525_713))
NONE = np.empty((0, 3), np.int64)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

_POWERS: dict[int, np.ndarray] = {}


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), remembered while short."""
    known = _POWERS.get(prime)
    if known is None or len(known) < n:
        known = np.ones(1, np.uint64)
        while len(known) < n:
            known = np.concatenate([known, known * np.uint64(pow(base, len(known), prime)) % np.uint64(prime)])
        if n <= 1 << 20:
            _POWERS[prime] = known
    return known[:n]


class Prefixes:
    """Hashes of all prefixes of a sequence of numbers, which compare any two stretches of it."""

    def __init__(self, ids: np.ndarray):
        letters = mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.sums = []
        for prime, base in HASHES:
            p, powers = np.uint64(prime), _powers(prime, base, len(ids) + 1)
            total = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(letters % p * powers[:-1] % p, out=total[1:])
            self.sums.append((p, powers, total % p))

    def same(self, i: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n numbers from i on seem equal to those from i + q on."""
        out, j = np.ones(len(i), bool), i + q
        for p, powers, total in self.sums:
            out &= (total[i + n] + p - total[i]) % p * powers[q] % p == (total[j + n] + p - total[j]) % p
        return out


def farthest(test, most: np.ndarray) -> np.ndarray:
    """The largest number up to most for which test(number) holds, element by element; it holds for 1."""
    low, high = np.ones(len(most), np.int64), most.copy()
    while (open_ := low < high).any():
        middle = np.where(open_, (low + high + 1) >> 1, low)
        good = test(middle)
        low, high = np.where(good, middle, low), np.where(good, high, np.maximum(middle - 1, low))
    return low


def _reach(ids: np.ndarray, shortest: int, times: int) -> np.ndarray:
    """Start, end and period of what the grids meet: rows that may repeat and may be too short."""
    n, hashes, found = len(ids), None, []
    periods = np.arange(1, n // times + 1)
    steps = np.maximum(shortest, times * periods) - periods
    points = (n - periods - 1) // steps + 1
    ends = np.cumsum(points)
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        count = points[at:to]
        q, step = np.repeat(periods[at:to], count), np.repeat(steps[at:to], count)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)) * step
        at = to
        near = ids[i] == ids[i + q]
        i, q, half = i[near], q[near], step[near] // 2 + 1  # of the equal places around a point, so many lie on one side, 3 at least
        j = np.minimum(i + 1, n - 1 - q)
        near = (ids[j] == ids[j + q]) & (j > i)
        j = np.maximum(i - 1, 0)
        near |= (ids[j] == ids[j + q]) & (j < i)
        if not near.any():
            continue
        i, q, half = i[near], q[near], half[near]
        hashes = hashes or Prefixes(ids)
        near = np.zeros(len(i), bool)
        for first, inside in ((i, i + q + half <= n), (i - half + 1, i - half + 1 >= 0)):
            near[inside] |= hashes.same(first[inside], q[inside], half[inside])
        i, q = i[near], q[near]
        if len(i):
            right = farthest(lambda m, i=i, q=q: hashes.same(i, q, m), n - i - q)
            left = farthest(lambda m, i=i, q=q: hashes.same(i - m + 1, q, m), i + 1)
            found.append(np.stack([i - left + 1, i + q + right, q], 1))
    return np.concatenate(found) if found else NONE


def _word_by_word(ids: np.ndarray, times: int) -> np.ndarray:
    """The same by comparing all words with those a period on."""
    found = []
    for q in range(1, len(ids) // times + 1):
        edge = np.diff(np.concatenate([[0], ids[q:] == ids[:-q], [0]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        found.append(np.stack([start, end, np.full(len(start), q)], 1))
    return np.concatenate(found) if found else NONE


def _distinct(found: np.ndarray, shortest: int, times: int) -> np.ndarray:
    """Of rows with the same start and end the one with the smallest period, without those that are too short."""
    found = found[found[:, 1] - found[:, 0] >= np.maximum(shortest, times * found[:, 2])]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def find_runs(ids: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers, ordered by start, then period."""
    found = _reach(ids, shortest, times) if len(ids) >= max(shortest, times) else NONE
    if not len(found):
        return NONE
    runs = _distinct(found, shortest, times)
    if not all(np.array_equal(ids[s : e - q], ids[s + q : e]) for s, e, q in runs.tolist()):
        runs = _distinct(_word_by_word(ids, times), shortest, times)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    runs[:, 1] -= runs[:, 0]
    return runs


def strongest(runs: np.ndarray) -> tuple[int | None, int | None, int | None]:
    """Start, length and period of the run that repeats most often; of equals the first, then that of the smallest period."""
    if not len(runs):
        return None, None, None
    share = runs[:, 1] / runs[:, 2]
    best = None
    for s, n, q in runs[share >= share.max() * (1 - 1e-9)].tolist():  # quotients of doubles may tie; products of integers don't
        if best is None or n * best[2] > best[1] * q:
            best = s, n, q
    return best


class Numbers(dict):
    """word -> its number, remembered from text to text."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_NUMBERS = Numbers()


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words of this text."""
    hold_caches("numbers", _NUMBERS.clear)
    if len(_NUMBERS) > CACHE_WORDS:
        _NUMBERS.clear()
    return np.array(list(map(_NUMBERS.__getitem__, words)), np.int64)


def repeats_of(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether any run holds a word after the run's first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def _search(shortest: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            found, best, left = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                runs = find_runs(numbered(words), shortest, times)
                found.append(runs)
                best.append(strongest(runs))
                if len(runs):
                    words = [w for w, out in zip(words, repeats_of(runs, len(words)).tolist(), strict=True) if not out]
                left.append(b" ".join(words).decode())
            flat, ends = np.concatenate(found), np.cumsum([0, *map(len, found)])
            each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), *(pa.array([b[k] for b in best], pa.int64()) for k in range(3)), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "start", "length", "period", "collapsed"])

    return run


def collapse(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, runs (by start, then period), start, length and period of the strongest run (null without
    one), collapsed (the words that no run repeats, joined by one space)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_search(shortest, times), f"doc_id long, runs {RUNS}, start long, length long, period long, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> the same, where one text in ten repeats: with h the crc32 of the decimal doc_id and g = h div 10,
    of n words those from a = g mod n on become the p words there, again and again, p = 1 + (n - a) div (3 + g mod 8). Which
    one is told by h mod 10 = 0; a row without doc_id or words stays."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    rows = rows.withColumn("p", F.when(n > 0, F.expr("cast(1 + (size(words) - a) div (3 + g % 8) as int)")))
    again = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((size(words) - a) / p) as int))), 1, size(words) - a)")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", 1, F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """collapse() with the runs and the text left as digests."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return collapse(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
