"""Token ids in Arrow stream files of equal-length sequences, with random access to sequences and documents.

A file is an Arrow IPC stream whose batches hold fixed-size lists: `ids` (unsigned 32-bit) and `mask` (1 for an id, 0 for
what fills the last sequence up). Lists of one size lie in one flat buffer, so sequence i, or any run of ids, is a view
without copying. The schema's metadata hold the documents of the file: their ids and where they start.

Documents are cut into files by ranges of doc_id that hold about PIECE_ROWS rows, or more where RANGES ranges (quantiles
that the driver holds) are not enough for that; the ranges come from quantiles of doc_id alone; a range that grows beyond `file_tokens` ids (long texts, repeated ids) becomes several files. Files are rows of a Parquet table in the shared
folder (name, bytes), as only Spark reaches every store; `save_files` puts them into a folder that machines mount, where `TokenFile.mapped` maps them.

Null and empty texts have the end id only. Rows with one doc_id follow each other ordered by their ids; null doc_ids come
first. An empty table gives no file. Further columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import io
import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import SHORT, Codec, byte_letters, plain
from .common import hold_caches, small_slices, written

SEQUENCE, FILE_TOKENS, PIECE_ROWS, RANGES = 2048, 1_000_000, 2_000, 20_000
#: Pieces of texts that each of two generations remembers, as the library takes long for a new one.
REMEMBERED = 300_000
#: Pieces that are looked up at once.
PIECES = 16_384
#: Bytes before which a plain text is cut.
_CUTS = bytes(c in b" \n,." for c in range(256))


class LibraryCodec(Codec):
    """Words are encoded by the tokenizers library and remembered. A shortcut, equal to its encode() of whole texts: texts are cut into pieces here, and the
    library's model takes a word in the file's letters for bytes, which leaves out what encode() does around that. The pieces of a batch of texts are numbered
    by Arrow, so that each distinct one is looked up once, and their ids are put together by Arrow."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.letters = "".join(byte_letters())
        self.model._resize_cache(0)  # words are remembered here
        #: Ids take two bytes if all of the file do.
        self.kind, self.form = ("<u2", "H") if max([self.largest, *self.special.values()]) < 65536 else ("<u4", "I")
        self.special_bytes = {x.encode(): self.pack([i]) for x, i in self.special.items()}
        self.has_special = re.compile(self.find_special.pattern.encode()) if self.special else None

    def load(self, model: dict) -> None:
        """The library has the parts."""
        self.largest = max(model["vocab"].values(), default=0)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.form}", *ids)

    def words_in(self, piece: bytes) -> list[bytes]:
        """The words of a piece as the pattern cuts them; letters after a space or none are one."""
        text = piece.decode()
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return [piece]
        return [x.encode() for x in self.pattern.findall(text)]

    def asked(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces by the library's model. No text holds the byte that stands between words while they are put in the file's letters. Lists don't
        pile up here, as Python's collector would go through them again and again."""
        words, ends = [], []
        for x in pieces:
            if x[0] == 32 and x[1:].isalpha():  # letters of ASCII after a space
                words.append(x)
            else:
                words += self.words_in(x)
            ends.append(len(words))
        ids, marks, tokenize = [], [0], self.model.tokenize
        for x in codecs.charmap_decode(b"\xff".join(words), "strict", self.letters)[0].split(self.letters[255]):
            ids += [t.id for t in tokenize(x)]
            marks.append(len(ids))
        packed, size = self.pack(ids), int(self.kind[-1])
        return [packed[a:b] for a, b in itertools.pairwise([0, *(size * marks[x] for x in ends)])]

    def remembered(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces. A full table becomes the older one, whose pieces move to the new one as they occur."""
        out = list(map(self.known.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        unknown = []
        for i in missing:
            x = pieces[i]
            if (found := self.older.get(x)) is None and (found := self.special_bytes.get(x)) is None:
                unknown.append(i)
            out[i] = found
        for i, x in zip(unknown, self.asked([pieces[i] for i in unknown]), strict=True):
            out[i] = x
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update((x, out[i]) for i in missing if len(x := pieces[i]) <= SHORT)
        return out

    def simple(self, data: bytes) -> bool:
        """Whether texts, one after another, are cut right at their begins and by single bytes."""
        return plain(data) and not (self.has_special and self.has_special.search(data))

    def places(self, part: bytes) -> np.ndarray:
        """Where the words of a text begin, or a special token."""
        words = [part] if part in self.special_bytes else [x.encode() for x in self.pattern.findall(part.decode())]
        return np.cumsum([0, *map(len, words[:-1])])

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts, as little-endian numbers of the codec's kind."""
        texts = pc.fill_null(texts, "")
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        if ends[0] == ends[-1]:
            return [b""] * len(texts)
        data = texts.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
        ends = ends - ends[0]
        codes = np.frombuffer(data, np.uint8)
        cut = np.frombuffer(bytearray(data.translate(_CUTS)), bool)
        cut[1:] |= codes[:-1] == 10
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        if not self.simple(data):
            for a, b in itertools.pairwise(ends.tolist()):
                for part in filter(None, self.has_special.split(data[a:b]) if self.has_special else [data[a:b]]):
                    cut[a] = True
                    if part in self.special_bytes or not plain(part):
                        cut[a + 1 : a + len(part)] = False
                        cut[a + self.places(part)] = True
                    a += len(part)
        at = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [x for i in range(0, len(distinct), PIECES) for x in self.remembered(distinct[i : i + PIECES])]
        ids = pa.array(known, pa.binary()).take(pieces.indices)
        flat = ids.buffers()[2].to_pybytes()
        marks = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4)[np.searchsorted(at, ends)]
        return [flat[a:b] for a, b in itertools.pairwise(marks.tolist())]

    def encode(self, text: str | None) -> bytes:
        return np.frombuffer(self.encode_all(pa.array([text], pa.string()))[0], self.kind).astype("<u4").tobytes()


@functools.cache
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, for the shuffle; four after a zero byte else."""
    return ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\0" + ids.astype("<u4").tobytes()


def _encode(path: str, end: int, cuts: np.ndarray):
    """doc_id, text -> doc_id, the range it lies in, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library_codec(path)
        hold_caches("token files", codec.forget)
        two, tail = codec.kind == "<u2" and end < 65536, np.array([end], "<u4")
        short = tail.astype("<u2").tobytes()
        for batch in small_slices(batches, 10_000):
            ids = codec.encode_all(batch.column("text"))
            ids = [x + short for x in ids] if two else [_packed(np.append(np.frombuffer(x, codec.kind).astype("<u4"), tail)) for x in ids]
            doc_ids = batch.column("doc_id")
            part = np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, doc_ids.fill_null(0).to_numpy(), "right"))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(part, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "ids"])

    return run


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], "<u4") if len(data) % 2 else np.frombuffer(data, "<u2").astype("<u4")


def write_stream(ids: np.ndarray, doc_ids: list, starts: np.ndarray, length: int = SEQUENCE) -> bytes:
    """An Arrow stream of one file's ids."""
    count = -(-len(ids) // length)
    flat = np.zeros(count * length, np.uint32)
    flat[: len(ids)] = ids
    mask = (np.arange(count * length) < len(ids)).astype(np.uint8)
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (flat, mask)]
    known = np.array([x is not None for x in doc_ids], np.uint8)
    meta = {"tokens": str(len(ids)), "starts": np.asarray(starts, "<i8").tobytes(), "doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(), "known": known.tobytes()}
    schema = pa.schema([pa.field("ids", lists[0].type), pa.field("mask", lists[1].type)], metadata=meta)
    out = io.BytesIO()
    with pa.ipc.new_stream(out, schema) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))
    return out.getvalue()


class TokenFile:
    """Views into a stream file: no ids are copied."""

    def __init__(self, data: bytes | pa.NativeFile):
        with pa.ipc.open_stream(pa.py_buffer(data) if isinstance(data, bytes) else data) as reader:
            batch, meta = reader.read_next_batch(), reader.schema.metadata
        self.length = batch.schema.field("ids").type.list_size
        self.flat = batch.column("ids").values.to_numpy(zero_copy_only=True)
        self.masks = batch.column("mask").values.to_numpy(zero_copy_only=True)
        self.tokens = int(meta[b"tokens"])
        self.starts = np.frombuffer(meta[b"starts"], "<i8")
        known = np.frombuffer(meta[b"known"], np.uint8)
        self.doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(meta[b"doc_ids"], "<i8"), known, strict=True)]

    @classmethod
    def mapped(cls, path: str) -> TokenFile:
        """A file of save_files() in memory that the system pages in as it is read: views lie in the file itself."""
        return cls(pa.memory_map(path))

    def __len__(self) -> int:
        return len(self.flat) // self.length

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(i * self.length, (i + 1) * self.length)
        return self.flat[at], self.masks[at]

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else self.tokens
        return self.flat[self.starts[k] : end]


def _write(length: int, file_tokens: int):
    """Rows sorted by (part, doc_id, ids) -> (part, piece, tokens, data); a part is one file, or several of bounded size."""
    names = ["part", "piece", "tokens", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, held, docs, size = None, 0, [], [], 0

        def file() -> pa.RecordBatch:
            lengths = [len(x) for x in held]
            data = write_stream(np.concatenate(held), docs, np.cumsum([0, *lengths[:-1]]), length)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([piece], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=names)

        for batch in batches:
            for doc, at, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "ids")), strict=True):
                if held and (at != part or size >= file_tokens):
                    yield file()
                    piece, held, docs, size = (0 if at != part else piece + 1), [], [], 0
                part = at
                held.append(_ids(data))
                docs.append(doc)
                size += len(held[-1])
        if held:
            yield file()

    return run


def write_token_files(docs: DataFrame, path: str, end: int = 0, length: int = SEQUENCE, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """docs(doc_id, text) -> the table of files (part, piece, tokens, data), ordered by (part, piece)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, min(-(-docs.count() // PIECE_ROWS), RANGES))
    # Cuts lie at quantiles of doc_id; a null counts as lower than all.
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    coded = docs.mapInArrow(_encode(path, end, np.array(cuts, np.int64)), "doc_id long, part long, ids binary")
    coded = coded.repartition(max(1, len(cuts) + 1), "part").sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_first(), "ids")
    files = written(coded.mapInArrow(_write(length, file_tokens), "part long, piece int, tokens long, data binary"), "token-files", "zstd")
    return files


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, 1):
        file = TokenFile(batch.column("data")[0].as_py())
        ids = [file.document(k) for k in range(len(file.starts))]
        part, piece = (pa.repeat(batch.column(c)[0], len(ids)) for c in ("part", "piece"))
        yield pa.RecordBatch.from_arrays([part, piece, pa.array(file.doc_ids, pa.int64()), pa.array(file.starts), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], names=["part", "piece", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """The table of files -> doc_id, start, n_tokens, ids_crc32, read from the files' bytes. Where a part begins is known from the sums of the
    parts, of which there are RANGES at most; where its files begin, within it."""
    sums = sorted(map(tuple, files.groupBy("part").agg(F.sum("tokens")).collect()))
    ends = list(itertools.accumulate(n for _, n in sums))
    parts = files.sparkSession.createDataFrame([(part, end - n) for (part, n), end in zip(sums, ends, strict=True)], "part long, first long")
    before = W.partitionBy("part").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    bases = files.select("part", "piece", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")).join(parts, "part")
    bases = bases.select("part", "piece", (F.col("first") + F.col("before")).alias("base"))
    rows = files.select("part", "piece", "data").mapInArrow(_read, "part long, piece int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "piece"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row of the table as a stream file of its own to a folder that all machines mount, whole or not at all: path, tokens. A task
    that runs again writes the same bytes under the same name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in small_slices(batches, 1, column="data"):
            part, piece, tokens, data = (batch.column(c)[0].as_py() for c in ("part", "piece", "tokens", "data"))
            path = f"{folder}/{part:08}-{piece:06}.arrows"
            aside = f"{folder}/.{uuid.uuid4().hex}"
            with open(aside, "wb") as f:
                f.write(data)
            os.replace(aside, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "tokens": [tokens]})

    return files.select("part", "piece", "tokens", "data").mapInArrow(run, "path string, tokens long")
