"""Scoring texts with an n-gram model that is learnt from the same corpus and never gathered in one place.

Tokens are words with A-Z lower-cased, then one end token that also stands before the first word. With training counts c:
p1(w) = (c(w) - d) / N for known words, d * V / N for the unknown one; the discount d comes from the words that occur once and
twice, d = n1 / (n1 + 2 * n2). Word pairs are mixed with them: p2(w | u) = share * c(u, w) / c(u) + (1 - share) * p1(w), and
p1(w) after a word that training texts don't have. Both sum to 1 over all words and the unknown one.

Documents are packed into chunks of bounded size; chunks and shards talk in three steps, so neither the driver nor any
task holds the model, all counts cover all documents, and traffic follows the input.
1. A chunk sends its distinct words with its training counts to shards (by hash); these return the totals over all chunks.
2. It sends its distinct pairs, context by context, to the shards of their contexts. Contexts with many occurrences are split over
   several shards by their successors: those with more than `hot` and more than one in MOST_HOT of all tokens, so MOST_HOT words at most,
   whose totals go to all tasks. A shard adds up the pairs of all chunks and builds its part of the model from those that
   occur in training texts: a trie of Elias-Fano coded context keys and pointers, successors in ascending order within
   their context, and log probabilities quantised to 16 bits, in one memory-mapped block.
3. Each chunk's pairs, also those that no training text has, are looked up in the trie: the context by search over the
   coded keys, the successor by search relative to its context's range. Nothing is decoded beyond the places visited.
   The chunk gets the quantised values back and mixes them with its words' probabilities.

Null and empty texts score their end token only. Repeated and null doc_ids are scored row by row (a null doc_id counts as
the empty string's crc32). An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, mixed, written

END = b""
CHUNK_BYTES = 2_000_000
#: Weight of pairs in the mixture.
SHARE = 0.3
#: Occurrences of a context in one shard, above which its successors are dealt out to several.
HOT, MOST_HOT = 500_000, 100_000
#: Quantisation of log10 probabilities: 65,535 equal steps down to LOWEST; UNSEEN is none of them.
LOWEST, UNSEEN = -24.0, 65535
SHARD_CHUNKS = 8


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logs, LOWEST, 0) / LOWEST * (UNSEEN - 1)).astype(np.uint16)


def unquantise(values: np.ndarray) -> np.ndarray:
    return values.astype(float) * (LOWEST / (UNSEEN - 1))


class EliasFano:
    """A monotone sequence: low bits packed as they are, high parts in unary as set bits of a bit vector, with the number
    of set bits before each 64 of them, by which a place is found without reading the others."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = min(56, max(0, (top // max(1, self.n)).bit_length() - 1))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        bits = np.zeros(-(-(int(high[-1]) + 1 if self.n else 1) // 64) * 64, np.uint8)
        bits[high] = 1
        self.high = np.packbits(bits, bitorder="little")
        self.before = np.r_[0, np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))]
        low = values & np.uint64((1 << self.low_bits) - 1)
        flat = ((low[:, None] >> np.arange(self.low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        self.low = np.r_[np.packbits(flat, bitorder="little"), np.zeros(8, np.uint8)]

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at some places: select over the high bits, then the low ones."""
        block = np.searchsorted(self.before, at, "right") - 1
        bits = np.unpackbits(self.high.reshape(-1, 8)[block], axis=1, bitorder="little")
        inside = (np.cumsum(bits, axis=1, dtype=np.uint8) == (at - self.before[block] + 1)[:, None]).argmax(axis=1)
        out = (block * 64 + inside - at).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = at * self.low_bits
            byte = bit >> 3
            word = np.zeros(len(at), np.uint64)
            for k in range(8):
                word |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
            out |= (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)
        return out


class Trie:
    """Contexts and, within each, ascending successors of 48 bits with quantised log10 probabilities, in one mapped block."""

    def __init__(self, contexts: np.ndarray, first: np.ndarray, successors: np.ndarray, logs: np.ndarray):
        """contexts: ascending keys; first: where each one's successors begin, and their number last."""
        self.contexts, self.pointers = EliasFano(contexts), EliasFano(first)
        levels = [("high", (successors >> np.uint64(32)).astype(np.uint16)), ("low", successors.astype(np.uint32)), ("logs", quantise(logs))]
        owners = [(e, name, getattr(e, name)) for e in (self.contexts, self.pointers) for name in ("high", "before", "low")]
        owners += [(self, name, x) for name, x in levels]
        self.block = mmap.mmap(-1, max(8, sum(-(-x.nbytes // 8) * 8 for _, _, x in owners)))
        place = 0
        for owner, name, x in owners:
            view = np.frombuffer(self.block, x.dtype, len(x), place)
            view[:] = x
            setattr(owner, name, view)
            place += -(-x.nbytes // 8) * 8

    def context(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of contexts, -1 where there is none: binary search over the coded keys, all at once."""
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), self.contexts.n)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            less = self.contexts.get(middle) < keys[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        found = np.flatnonzero(low < self.contexts.n)
        found = found[self.contexts.get(low[found]) == keys[found]]
        out = np.full(len(keys), -1)
        out[found] = low[found]
        return out

    def find(self, keys: np.ndarray, counts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Contexts, how many successors are asked of each, these -> quantised values, UNSEEN where there is none:
        binary search inside each context's range, all at once."""
        number = self.context(keys)
        known = np.maximum(number, 0)
        begin, end = (self.pointers.get(known + k).astype(np.int64) * (number >= 0) for k in (0, 1)) if self.contexts.n else (np.zeros(len(keys), np.int64),) * 2
        low, high = np.repeat(begin, counts), np.repeat(end, counts)
        last = high.copy()
        value = lambda at: (self.high[at].astype(np.uint64) << np.uint64(32)) | self.low[at]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            less = value(middle) < successors[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        out = np.full(len(successors), UNSEEN, np.uint16)
        found = np.flatnonzero(low < last)
        found = found[value(low[found]) == successors[found]]
        out[found] = self.logs[low[found]]
        return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> rows of many documents, each of CHUNK_BYTES or one document."""
    docs: list = []
    texts: list = []
    size = 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([docs], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))], names=["doc_ids", "texts"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            docs.append(doc)
            texts.append(text or "")
            size += len(text or "") + 8
            if size >= CHUNK_BYTES:
                yield row()
                docs, texts, size = [], [], 0
    if docs:
        yield row()


def pack_keys(keys: np.ndarray, shards: int) -> bytes:
    """Ascending keys of one shard: steps between key // shards, in as few bytes each as all of them need."""
    parts = keys // np.uint64(shards)
    steps = np.diff(parts, prepend=np.uint64(0))
    size = next(b for b in (6, 7, 8) if b == 8 or not len(steps) or steps.max() < 1 << 8 * b)
    return bytes([size]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    """key // shards of packed keys: as good as the keys within one shard."""
    flat = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, : data[0]] = flat
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def squeeze(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unsqueeze(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def pack_successors(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_successors(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


class Hot:
    """Words whose successors are split, ascending by hash, with their totals and the occurrences of one part."""

    def __init__(self, hashes: np.ndarray, totals: np.ndarray, size: int):
        self.hashes, self.totals, self.size = hashes, totals, size

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals, 0 for other words, and parts, 1 for these."""
        totals = np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            totals[hit] = self.totals[at[hit]]
        return totals, (totals // self.size + 1).astype(np.uint64)


class Chunk:
    """Tokens of a chunk as local numbers; the end token is number 0."""

    def __init__(self, row: dict, folds: int):
        number: dict[bytes, int] = {END: 0}
        flat, lengths = [0], []
        for text in row["texts"]:
            words = text.encode().lower().split()
            flat.extend([number.setdefault(w, len(number)) for w in words])
            flat.append(0)
            lengths.append(len(words) + 1)
        self.doc_ids, self.lengths = row["doc_ids"], np.array(lengths, np.int64)
        self.tokens, self.before = np.array(flat[1:], np.int64), np.array(flat[:-1], np.int64)
        self.held_out = np.array([zlib.crc32(b"" if x is None else str(x).encode()) % folds == 0 for x in self.doc_ids])
        self.owner = np.repeat(np.arange(len(lengths)), self.lengths)
        self.train = ~self.held_out[self.owner]
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)
        self.words = len(number)

    def by_word(self, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, its words in ascending order of their hash)."""
        shard = (self.hashes % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.hashes, shard))
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            yield s, order[edges[s] : edges[s + 1]]

    def counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=self.words)

    def totals(self, answers: list[dict], shards: int) -> np.ndarray:
        got, out = {x["shard"]: x["totals"] for x in answers}, np.zeros(self.words, np.int64)
        for s, places in self.by_word(shards):
            out[places] = _unsqueeze(got[s], np.int64)
        return out

    def pairs(self, shards: int, hot: Hot) -> None:
        """Distinct pairs in the order in which shards are asked for them, with the totals of their contexts if these are hot (else 0)."""
        pairs, pair_of = np.unique(self.before * self.words + self.tokens, return_inverse=True)
        first, second = pairs // self.words, pairs % self.words
        totals, parts = hot(self.hashes)
        with np.errstate(over="ignore"):
            key = mixed(self.hashes[first] * MULTIPLIER + self.hashes[second] % parts[first])
        successor = self.hashes[second] >> np.uint64(16)
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((successor, key, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.first, self.second, self.key, self.successor = first[order], second[order], key[order], successor[order]
        self.context_totals = totals[self.first]
        self.pair_of = place[pair_of]
        self.edges = np.searchsorted(shard[order], np.arange(shards + 1))

    def by_context(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        """(shard, its pairs, where among them each context begins)."""
        for s in np.flatnonzero(np.diff(self.edges)).tolist():
            at = slice(int(self.edges[s]), int(self.edges[s + 1]))
            keys = self.key[at]
            yield s, at, np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _ask_words(shards: int, folds: int):
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, folds)
            counts = chunk.counts()
            out = [(s, row["chunk"], pack_keys(chunk.hashes[places], shards), squeeze(counts[places])) for s, places in chunk.by_word(shards)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _answer_words(key: tuple, table: pa.Table) -> pa.Table:
    """All questions to a shard -> totals for each chunk; in its first row sums over the shard's own words, and its frequent ones."""
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    new = np.r_[True, flat[order][1:] != flat[order][:-1]]
    counts = np.concatenate([_unsqueeze(x, np.int64) for x in table.column("counts").to_pylist()])
    totals = np.add.reduceat(counts[order], np.flatnonzero(new))
    answer = np.empty(len(flat), np.int64)
    answer[order] = totals[np.cumsum(new) - 1]
    rest = len(keys) - 1
    sums = {"n": totals.sum(), "v": (totals > 0).sum(), "once": (totals == 1).sum(), "twice": (totals == 2).sum()}
    back = [squeeze(x) for x in np.split(answer, np.cumsum([len(k) for k in keys])[:-1])]
    # Only a word with one in MOST_HOT of the tokens of all shards can be hot, so of those of one shard.
    often = totals * MOST_HOT >= totals.sum()
    names = {"often": flat[order][new][often].astype(np.int64), "often_totals": totals[often]}
    lists = {k: pa.array([v, *[[]] * rest], pa.list_(pa.int64())) for k, v in names.items()}
    return pa.table({"shard": pa.array([int(key[0].as_py())] * len(keys), pa.int32()), "chunk": table.column("chunk"), "totals": pa.array(back, pa.binary())} | {k: pa.array([int(v), *[0] * rest], pa.int64()) for k, v in sums.items()} | lists)


def _ask_pairs(shards: int, folds: int, hot: Hot):
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("keys", "sizes", "totals", "successors", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, folds)
            chunk.pairs(shards, hot)
            counts = np.bincount(chunk.pair_of[chunk.train], minlength=len(chunk.first))
            out = []
            for s, at, begins in chunk.by_context():
                sizes = np.diff(np.r_[begins, at.stop - at.start]).astype(np.uint32)
                out.append((s, row["chunk"], pack_keys(chunk.key[at][begins], shards), squeeze(sizes), squeeze(chunk.context_totals[at][begins]), pack_successors(chunk.successor[at]), squeeze(counts[at])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


class Shard:
    """All pairs that a shard is asked for, and its part of the model."""

    def __init__(self, keys: np.ndarray, successors: np.ndarray, counts: np.ndarray, totals: np.ndarray, share: float):
        """Pairs of context keys and successors, which may repeat, with training counts, and the totals of split contexts (else 0: a whole
        context's total is the sum of its pairs)."""
        order = np.lexsort((successors, keys))
        keys, successors = keys[order], successors[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (successors[1:] != successors[:-1])][: len(keys)]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        sums = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)
        keys, self.successors, told = keys[first], successors[first], totals[order][first]
        begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        self.keys, self.sizes = keys[begins], np.diff(np.r_[begins, len(keys)])
        whole = np.repeat(np.add.reduceat(sums, begins), self.sizes) if len(begins) else sums
        seen = sums > 0
        logs = np.log10(share * sums[seen] / np.where(told[seen] > 0, told[seen], whole[seen]))
        held = keys[seen]
        starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]][: len(held)])
        self.trie = Trie(held[starts], np.r_[starts, len(held)], self.successors[seen], logs)

    def answers(self) -> np.ndarray:
        """What the trie holds for each pair, as they came; each distinct one is searched once."""
        return self.trie.find(self.keys, self.sizes, self.successors)[self.place]


def _answer_pairs(share: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """All questions to a shard -> what each chunk finds in its trie."""
        column = lambda name, f: [f(x) for x in table.column(name).to_pylist()]
        sizes, successors = column("sizes", lambda x: _unsqueeze(x, np.uint32)), column("successors", unpack_successors)
        ends = np.cumsum([len(x) for x in successors])[:-1]
        each = np.concatenate(sizes)
        keys = np.repeat(np.concatenate(column("keys", unpack_keys)), each)
        totals = np.repeat(np.concatenate(column("totals", lambda x: _unsqueeze(x, np.int64))), each)
        counts = np.concatenate(column("counts", lambda x: _unsqueeze(x, np.int64)))
        found = Shard(keys, np.concatenate(successors), counts, totals, share).answers()
        back = [squeeze(x) for x in np.split(found, ends)]
        return pa.table({"shard": pa.array([int(key[0].as_py())] * len(back), pa.int32()), "chunk": table.column("chunk"), "values": pa.array(back, pa.binary())})

    return run


class Words:
    """Probabilities of words from their totals."""

    def __init__(self, n: int, v: int, once: int, twice: int):
        self.n, self.v = n, v
        self.discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    def base(self, totals: np.ndarray) -> np.ndarray:
        """log10 of the plain unigram model that scores are compared with."""
        return np.log10((totals + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def __call__(self, totals: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(totals))
        return np.where(totals > 0, totals - self.discount, self.discount * self.v) / self.n


def _score(shards: int, folds: int, share: float, hot: Hot, model: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, folds)
            totals = chunk.totals(row["words"], shards)
            chunk.pairs(shards, hot)
            got = {x["shard"]: x["values"] for x in row["pairs"]}
            values = np.concatenate([_unsqueeze(got[s], np.uint16) for s, _, _ in chunk.by_context()])
            single, base = model(totals), model.base(totals)
            pair = np.where(values == UNSEEN, 0.0, 10.0 ** unquantise(values))
            left = np.where(totals[chunk.first] > 0, 1 - share, 1.0)
            log = np.log10(pair + left * single[chunk.second])
            docs = len(chunk.doc_ids)
            sums = [np.bincount(chunk.owner, weights=x, minlength=docs) for x in (chunk.tokens >= 0, totals[chunk.tokens] > 0, base[chunk.tokens], log[chunk.pair_of])]
            cols = [pa.array(chunk.doc_ids, pa.int64()), pa.array(chunk.held_out), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(np.full(docs, model.n, np.int64)), pa.array(sums[2]), pa.array(sums[3])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _hot(words: DataFrame, shards: int, size: int) -> Hot:
    """Words with more than `size` occurrences; fewer than MOST_HOT, as size is at least one in MOST_HOT of all tokens."""
    rows = words.select("shard", F.explode(F.arrays_zip("often", "often_totals")).alias("x")).filter(F.col("x.often_totals") > size).select("shard", "x.*").collect()
    # A shard knows its words by hash // shards.
    found = sorted((r.often % 2**64 * shards + r.shard, r.often_totals) for r in rows)
    return Hot(np.array([h for h, _ in found], np.uint64), np.array([t for _, t in found], np.int64), size)


def lm_scores(docs: DataFrame, folds: int = 10, share: float = SHARE, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id as text) mod folds is not 0; scores all."""
    if folds < 2 or not 0 < share < 1 or hot < 1:
        raise ValueError("at least two folds, a share between 0 and 1 and a positive number of hot occurrences are needed")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = docs.mapInArrow(_pack, "doc_ids array<long>, texts array<string>").withColumn("chunk", F.monotonically_increasing_id())
    packed = written(packed, "chunks", "zstd")
    shards = max(1, -(-packed.count() // SHARD_CHUNKS))
    asked = packed.mapInArrow(_ask_words(shards, folds), "shard int, chunk long, keys binary, counts binary")
    words = written(asked.groupBy("shard").applyInArrow(_answer_words, "shard int, chunk long, totals binary, n long, v long, once long, twice long, often array<long>, often_totals array<long>"), "words")
    model = Words(*(x or 0 for x in words.agg(*(F.sum(c) for c in ("n", "v", "once", "twice"))).first()))
    frequent = _hot(words, shards, max(hot, model.n // MOST_HOT))
    asked = packed.mapInArrow(_ask_pairs(shards, folds, frequent), "shard int, chunk long, keys binary, sizes binary, totals binary, successors binary, counts binary")
    pairs = written(asked.groupBy("shard").applyInArrow(_answer_pairs(share), "shard int, chunk long, values binary"), "pairs")
    back = words.groupBy("chunk").agg(F.collect_list(F.struct("shard", "totals")).alias("words")).join(pairs.groupBy("chunk").agg(F.collect_list(F.struct("shard", "values")).alias("pairs")), "chunk")
    return packed.join(back, "chunk").mapInArrow(_score(shards, folds, share, frequent, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
