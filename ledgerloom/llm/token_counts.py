"""Numbers of tokens of whole texts, by lookup in two tiers.

A text is cut where no token reaches over (`bpe.stretches`, else the tokenizer's own pattern), and its tokens are the sum
over the pieces. The lengths of frequent pieces stand in one compact table that is broadcast: open addressing over 64-bit
hashes, with the pieces' bytes beside them, so that a hit is an equal piece and not only an equal hash. A batch's pieces are
numbered by Arrow, so each distinct piece of a batch is looked up once, all of them by NumPy. What the table misses is encoded by the tokenizers
library and kept in a cache of the worker, in two generations of bounded size. Pieces are never shuffled.

The table holds at most FREQUENT pieces, the most frequent ones of at most SAMPLE texts (those with the smallest hashes). It
decides which tier answers, never what the answer is. Each task of the sample counts with a bounded table and hands the driver
one packed row; a text is counted whole.

Null texts count as empty, with no tokens and 0 bytes. A special token of the file that stands in a text is one token, as the
library has it. Very long texts are cut into blocks of about BLOCK characters where a single space stands between other
characters, so that pieces of one block are held at a time. Rows are counted one by one: repeated and null doc_ids and
further columns don't matter; an empty table gives an empty result, also when the table of frequent pieces is empty.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, stretches
from .common import hold_caches, sampled, small_slices

SAMPLE, FREQUENT, CACHED, BLOCK, LIMIT = 2_000, 32_768, 200_000, 1_000_000, 1024
#: Tasks that count the sample, and pieces each of them keeps while it counts.
COUNTERS, COUNTED = 8, 262_144
_SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")


class LengthTable:
    """Pieces and their numbers of tokens in flat arrays: slots of hashes, the entry of each slot, where its bytes stand."""

    def __init__(self, entries: dict[bytes, int] | None = None, packed: bytes | None = None):
        if packed is not None:
            slots, count, size = struct.unpack_from("<QQQ", packed)
            at = 24
            for name, kind, n in (("hashes", "<u8", slots), ("entry", "<u4", slots), ("ends", "<u4", count + 1), ("lengths", "<u4", count)):
                setattr(self, name, np.frombuffer(packed, kind, n, at))
                at += n * np.dtype(kind).itemsize
            self.bytes = np.frombuffer(packed, np.uint8, size, at)
            return
        pieces = list(entries or {})
        slots = 1 << max(4, (2 * len(pieces)).bit_length())
        self.hashes, self.entry = np.zeros(slots, "<u8"), np.zeros(slots, "<u4")  # entry 0: nothing here
        for k, piece in enumerate(pieces, 1):
            h = xxhash.xxh3_64_intdigest(piece)
            at = h & (slots - 1)
            while self.entry[at]:
                at = (at + 1) & (slots - 1)
            self.hashes[at], self.entry[at] = h, k
        self.ends = np.cumsum([0, *map(len, pieces)]).astype("<u4")
        self.lengths = np.array([entries[p] for p in pieces], "<u4")
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def pack(self) -> bytes:
        parts = [self.hashes, self.entry, self.ends, self.lengths, self.bytes]
        return struct.pack("<QQQ", len(self.hashes), len(self.lengths), len(self.bytes)) + b"".join(x.tobytes() for x in parts)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The number of tokens of each string; -1 for those that are not in the table."""
        ends = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, pieces.offset * 4).astype(np.int64)
        data = pieces.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        whole = memoryview(data)
        hashes = np.array([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.uint64)
        mask = np.uint64(len(self.hashes) - 1)
        out, open_, at = np.full(len(pieces), -1, np.int64), np.arange(len(pieces)), hashes & mask
        while len(open_):
            entry = self.entry[at].astype(np.int64)
            hit = (entry > 0) & (self.hashes[at] == hashes[open_])
            hit[hit] = self._equal(entry[hit] - 1, data, ends[open_[hit]], ends[open_[hit] + 1])
            out[open_[hit]] = self.lengths[entry[hit] - 1]
            more = (entry > 0) & ~hit
            open_, at = open_[more], (at[more] + np.uint64(1)) & mask
        return out

    def _equal(self, entries: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether entries hold the bytes from start to end."""
        own = self.ends[entries].astype(np.int64)
        size = end - start
        same = self.ends[entries + 1] - own == size
        rows = np.flatnonzero(same & (size > 0))
        if len(rows):
            n = size[rows]
            first = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(first, n)
            equal = self.bytes[np.repeat(own[rows], n) + step] == data[np.repeat(start[rows], n) + step]
            same[rows] = np.logical_and.reduceat(equal, first)
        return same


class Counting:
    """Numbers of tokens by the table, then by the cache, then by the library."""

    def __init__(self, path: str, table: LengthTable):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern, self.table = regex.compile(PATTERN), table
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def forget(self) -> None:
        self.known.clear()
        self.older.clear()

    def blocks(self, text: str) -> Iterator[str]:
        """A text, or its blocks. Special tokens stand between them by themselves."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            at = 0
            while not k % 2 and len(part) - at > BLOCK and (cut := _SAFE.search(part, at + BLOCK)):
                yield part[at : cut.start()]
                at = cut.start()
            if at < len(part):
                yield part[at:]

    def pieces(self, block: str) -> list[str]:
        if self.special and self.special.fullmatch(block):
            return [block]
        lead = " " if block[0] == " " and len(block) > 1 else ""
        cut = stretches(block[len(lead) :])
        if cut is None:
            return self.pattern.findall(block)
        # A stretch follows a space, if it is not the first one and no line break, comma or full stop leads it.
        return [lead + cut[0], *[x if x[0] in "\n,." else " " + x for x in cut[1:]]]

    def encoded(self, pieces: list[str]) -> list[int]:
        """By the library, if the cache doesn't know them."""
        out, new = [], []
        for x in pieces:
            n = self.known.get(x)
            if n is None and (n := self.older.get(x)) is None:
                new.append(x)
            out.append(n)
        if new:
            counts = iter([len(x.ids) for x in self.tokenizer.encode_batch(new, add_special_tokens=False)])
            out = [next(counts) if n is None else n for n in out]
        for x, n in zip(pieces, out, strict=True):
            if len(self.known) >= CACHED:
                self.older, self.known = self.known, {}
            if len(x) <= 64:
                self.known[x] = n
        return out

    def lengths(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of tokens of distinct pieces."""
        out = self.table.find(pieces)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            out[missing] = self.encoded(pieces.take(pa.array(missing)).to_pylist())
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """Numbers of tokens of texts."""
        out = [0] * len(texts)
        held: list[str] = []
        ends: list[tuple[int, int]] = []

        def settle() -> None:
            coded = pa.array(held, pa.string()).dictionary_encode()
            sums = np.concatenate([[0], np.cumsum(self.lengths(coded.dictionary)[coded.indices.to_numpy()])])
            at = 0
            for k, end in ends:
                out[k] += int(sums[end] - sums[at])
                at = end
            held.clear()
            ends.clear()

        size = 0
        for k, text in enumerate(texts):
            for block in self.blocks(text or ""):
                held.extend(self.pieces(block))
                ends.append((k, len(held)))
                size += len(block)
                if size >= BLOCK:
                    settle()
                    size = 0
        if held:
            settle()
        return out


_LAST: list = [None, None]


def _counting(path: str, key: str, sent: Broadcast) -> Counting:
    """The worker's, made anew for each broadcast table."""
    if _LAST[0] != (path, key):
        _LAST[:] = (path, key), Counting(path, LengthTable(packed=sent.value))
    return _LAST[1]


@functools.cache
def _cutter(path: str) -> Counting:
    return Counting(path, LengthTable())


def _sample_counts(path: str, most: int):
    """Texts -> one row for each task: its most frequent pieces with their counts, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = _cutter(path), Counter()
        for batch in small_slices(batches):
            for text in batch.column("text").to_pylist():
                for block in cutter.blocks(text or ""):
                    seen.update(x for x in cutter.pieces(block) if len(x) <= 64)
                    if len(seen) > COUNTED:
                        seen = Counter(dict(seen.most_common(COUNTED // 2)))
        first = heapq.nsmallest(most, seen.items(), key=lambda x: (-x[1], x[0]))
        yield pa.RecordBatch.from_pydict({"pieces": [json.dumps(first)]})

    return run


def frequent_pieces(docs: DataFrame, path: str, sample: int = SAMPLE, most: int = FREQUENT) -> LengthTable:
    """The table for docs(text): at most `most` pieces, from at most `sample` texts."""
    texts = sampled(docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''"), sample).select("text")
    seen: Counter = Counter()
    for row in texts.repartition(COUNTERS).mapInArrow(_sample_counts(path, most), "pieces string").collect():
        seen.update(dict(json.loads(row.pieces)))
    pieces = [x for x, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]]
    return LengthTable({x.encode(): n for x, n in zip(pieces, _cutter(path).encoded(pieces), strict=True)})


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, table: LengthTable | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit (more tokens than the limit)."""
    sent, key = docs.sparkSession.sparkContext.broadcast((table or frequent_pieces(docs, path)).pack()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counting(path, key, sent)
        hold_caches("token counts", counting.forget)
        for batch in small_slices(batches):
            n = pa.array(counting.counts(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
