"""Binary media columns: PNG images written and read through zlib chunks, and perceptual hashes of their samples.

write_png/read_png handle 8-bit grey images of any size. The writer filters each row as suits it; the reader checks the signature, every chunk's CRC-32 and the
length of the samples, and undoes all five filters with numpy. `perceptual_hash` takes the low frequencies of a cosine
transform of the image, averaged to 32 x 32, each axis by itself; rows are repeated where there are fewer than 32.

Null texts count as empty; an empty payload becomes one row of 64 zero samples. A text of any length is one image, held whole by its
task; an empty table gives an empty result. Equal texts give equal values. Rows are
handled one by one, so repeated or null doc_ids and further columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of one data chunk.
IDAT = 65_536
SIDE, LOW = 32, 8
_COSINES = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5) * np.arange(LOW)[:, None])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: np.ndarray, level: int = 1, filtering: int | None = None) -> bytes:
    """An 8-bit grey image; filtering 0 (none), 1 (left) or 2 (above) for all rows, or for each row the one whose bytes are
    nearest to zero."""
    if filtering not in (None, 0, 1, 2):
        raise ValueError("only filters 0 to 2 are written")
    height, width = samples.shape
    plain = samples.astype(np.uint8)
    left, above = plain.copy(), plain.copy()
    left[:, 1:] -= plain[:, :-1]
    above[1:] -= plain[:-1]
    ways = np.stack([plain, left, above])
    if filtering is None:
        kinds = np.abs(ways.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0).astype(np.uint8)
    else:
        kinds = np.full(height, filtering, np.uint8)
    raw = zlib.compress(np.concatenate([kinds[:, None], ways[kinds, np.arange(height)]], axis=1).tobytes(), level)
    parts = b"".join(_chunk(b"IDAT", raw[i : i + IDAT]) for i in range(0, len(raw), IDAT))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + parts + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows. Rows that look to the left are undone at once, runs of rows that look up by sums, the others
    value by value."""
    if kinds.max(initial=0) > 4:
        raise ValueError(f"filter {kinds.max()} is unknown")
    out = rows.copy()
    left = kinds == 1
    out[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
    edges = np.r_[0, np.flatnonzero(np.diff(kinds)) + 1, len(kinds)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        kind = kinds[a]
        if kind == 2:
            first = rows[a] + out[a - 1] if a else rows[a]
            out[a:b] = np.cumsum(np.concatenate([first[None], rows[a + 1 : b]]), axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(a, b):
                _undo(int(kind), rows[y], out[y - 1] if y else np.zeros(rows.shape[1], np.uint8), out[y])
    return out


def _undo(kind: int, row: np.ndarray, above: np.ndarray, out: np.ndarray) -> None:
    """One row with filter 3 (mean of left and above) or 4 (whichever of left, above and corner is nearest to their sum)."""
    left = corner = 0
    for x, (value, up) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        guess = (left + up) // 2
        if kind == 4:
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        left, corner = (value + guess) & 255, up
        out[x] = left


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey image without interlacing; ValueError if anything about it is not right."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts, head, ended = 8, [], None, False
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey image")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("the samples have another length")
    raw = raw.reshape(head[1], head[0] + 1)
    return _unfilter(raw[:, 0], raw[:, 1:])


def _averaged(values: np.ndarray, axis: int) -> np.ndarray:
    """One axis brought to SIDE places: each the mean of its share of the values, which are repeated where there are fewer."""
    n = values.shape[axis]
    at = np.arange(SIDE) * n // SIDE
    if n < SIDE:
        return values.take(at, axis)
    sizes = np.diff(np.r_[at, n])
    return np.add.reduceat(values, at, axis=axis) / (sizes if axis else sizes[:, None])


def perceptual_hash(samples: np.ndarray) -> str:
    """64 bits as hexadecimal: which low-frequency cosine coefficients lie above their median."""
    sums = _averaged(_averaged(samples.astype(np.float64), 1), 0)
    low = np.rint(_COSINES @ sums @ _COSINES.T * 1e6)
    return np.packbits(low.ravel() > np.median(low)).tobytes().hex()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, 64):
        sizes, media = [], []
        for text in batch.column("text").to_pylist():
            data = (text or "").encode()
            sizes.append(len(data))
            data += b"\0" * (max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))
            media.append(write_png(np.frombuffer(data, np.uint8).reshape(-1, WIDTH)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media (PNG of the text's bytes, 64 samples a row, zeros at the end)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, 64):
        rows = []
        for media in batch.column("media").to_pylist():
            samples = read_png(media)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), perceptual_hash(samples)))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in FEATURES.split(", ")])


def media_features(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) -> what the stored bytes hold when they are read back, and their features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)
