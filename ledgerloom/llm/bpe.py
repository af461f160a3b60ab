"""Byte-level BPE, encoded and decoded here, with ranks and vocabulary of a public tokenizer file.

A short word is encoded in place: an array of part boundaries with, beside each, the rank of joining the part with the
next one. The array is scanned for the lowest rank (the leftmost of equals), that boundary is deleted, the ranks of the two
neighbours are looked up anew, until no rank is left. Words over SHORT bytes keep the same array in a linked list with a
heap, which gives the same merges in n log n. Words repeat, so each is encoded once per worker.

Null texts count as empty; texts of any length are encoded whole; an empty table gives an empty result. Special tokens of the file that occur in a text become their own ids. Rows are handled one by
one, so repeated or null doc_ids and further columns don't matter.
"""

from __future__ import annotations

import array
import functools
import heapq
import json
import re
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold_caches, small_slices

# Fixed values of the tokenizer format: the pattern that cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, CACHED, CACHED_WORDS = 96, 200_000, 100_000
#: Characters of a stretch that is no word and yet remembered.
KEPT = 24
_NONE = 1 << 60
#: Whether the machine's own unsigned integers are little-endian 32-bit numbers.
_NATIVE = sys.byteorder == "little" and array.array("I").itemsize == 4
#: Texts as bytes, letters and digits made a, blanks and line breaks a blank, commas and full stops a full stop, bytes over 127 h and
#: all else x, so that few searches tell whether a text is plain.
_SHAPE = bytes(32 if c in b" \n" else 46 if c in b".," else 97 if chr(c).isalnum() else 120 for c in range(128)).ljust(256, b"h")
_BREAKS = (b"  ", b" .", b"x.", b"..")
_ODD = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: White space over 127 in UTF-8, and the bytes that it begins with.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LEADS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")


def plain(data: bytes) -> bool:
    """Whether a text in UTF-8 can be cut by single bytes: before a single space or line break between other characters, and before a
    comma or full stop after a letter or digit. It holds nothing else of that kind, and no word reaches over these places."""
    if data[0] in b" \n.," or data[-1] in b" \n":
        return False
    shape = data.translate(_SHAPE)
    if any(x in shape for x in _BREAKS) or any(x in data for x in _ODD):
        return False
    if not data.isascii():
        if any(x in data for x in _LEADS) and _WIDE.search(data):
            return False
        at = shape.find(b"h.")
        while at >= 0:
            begin = at
            while data[begin] & 0xC0 == 0x80:
                begin -= 1
            if not data[begin : at + 1].decode().isalnum():
                return False
            at = shape.find(b"h.", at + 1)
    return True


def stretches(text: str) -> list[str] | None:
    """A text cut where no word reaches over, or None if it isn't plain. The first stretch is as it is; others follow a space, but for
    those that begin with a line break, comma or full stop."""
    if not plain(text.encode()):
        return None
    return text.replace("\n", " \n").replace(",", " ,").replace(".", " .").split(" ")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the file: visible Latin-1 for itself, others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(other)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.token: dict[int, bytes] = {}
        self.load(file["model"])
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        #: Ids of words as the pattern cuts them, and of words of letters after a space.
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def load(self, model: dict) -> None:
        """Ids of parts, their bytes by id, and ranks of pairs."""
        back = {c: b for b, c in enumerate(byte_letters())}
        as_bytes = lambda token: bytes(back[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        self.token = {i: t for t, i in self.ids.items()}
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((as_bytes(a), as_bytes(b)), rank)

    def parts(self, word: bytes) -> list[bytes]:
        """The parts of a word after all merges."""
        if len(word) > SHORT:
            return self._long(word)
        bounds = list(range(len(word) + 1))
        get = self.ranks.get
        rank = [get((word[i : i + 1], word[i + 1 : i + 2]), _NONE) for i in range(len(word) - 1)]
        while rank:
            low = min(rank)
            if low == _NONE:
                break
            i = rank.index(low)
            del bounds[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), _NONE)
            if i:
                rank[i - 1] = get((word[bounds[i - 1] : bounds[i]], word[bounds[i] : bounds[i + 1]]), _NONE)
        return [word[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _long(self, word: bytes) -> list[bytes]:
        n, get = len(word), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; -1: no such part
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if end[i] != middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := get((word[i:stop], word[stop : end[stop]]))) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := before[i]) >= 0 and (r := get((word[p:i], word[i:stop]))) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def forget(self) -> None:
        for x in (self.words, self.known, self.older):
            x.clear()

    def ids_of(self, word: str) -> bytes:
        """Ids of one word as the pattern cuts them."""
        return self.pack([self.ids[p] for p in self.parts(word.encode())])

    def _word(self, word: str) -> bytes:
        found = self.ids_of(word)
        if len(word) <= SHORT:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array.array("I", ids).tobytes() if _NATIVE else struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, text: str) -> bytes:
        """Ids of a stretch as stretches() gives them, as little-endian 32-bit numbers. Only words of letters are
        remembered, and short other ones; two generations of them, so that frequent ones outlive a full table."""
        if text.isalpha():
            if (found := self.older.get(text)) is None:
                found = self.ids_of(" " + text)
            if len(text) <= SHORT:
                if len(self.known) >= CACHED:
                    self.older, self.known = self.known, {}
                self.known[text] = found
            return found
        if text[0] == "\n" and text[1:].isalpha():  # a line break and a word by itself
            get = self.words.get
            return b"".join([x if (x := get(w)) is not None else self._word(w) for w in ("\n", text[1:])])
        if (found := self.older.get(text)) is None:
            found = self._words(text if text[0] in "\n,." else " " + text)
        if len(text) <= KEPT:
            self.known[text] = found
        return found

    def _words(self, text: str) -> bytes:
        get = self.words.get
        return b"".join([x if (x := get(w)) is not None else self._word(w) for w in self.pattern.findall(text)])

    def _plain(self, text: str) -> bytes:
        if (pieces := stretches(text)) is None:
            return self._words(text)
        get, make = self.known.get, self._stretch
        return self._words(pieces[0]) + b"".join([p if (p := get(x)) is not None else make(x) for x in pieces[1:]])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self.find_special is None or not self.find_special.search(text):
            return self._plain(text)
        return b"".join(self.pack([self.special[x]]) if x in self.special else self._plain(x) for x in self.find_special.split(text) if x)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("bpe", codec.cache_clear)
        bpe = codec(path)
        for batch in small_slices(batches, 64):
            ids = [bpe.encode(x) for x in batch.column("text").to_pylist()]
            texts = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids (little-endian 32-bit numbers), decoded (the text of the ids)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_run(path), "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
