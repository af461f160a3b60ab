"""Quality of documents by a linear-chain conditional random field over their lines.

Each line is good or bad. Its evidence are shares of kinds of characters, lengths and repetition, of the line itself and
of the lines before and after it; a transition weight joins the labels of neighbours. Forward-backward sums give every
line's marginal; a document's score is their mean, weighted by length.

Training: a document's label holds for all its lines; likelihood is climbed with Adam on whole texts of a bounded sample
(`sample_rows` labelled documents, a parameter). Scoring reads whole texts.

Null and empty texts are one empty line. A text of any length is scored whole, one at a time; so is a very long line. Without labels in the sample (an empty table) every score is the share 0.5.
Documents with several labels teach each of them. Repeated or null doc_ids are scored row by row; further columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, small_slices

OWN = 15
FEATURES = 3 * OWN + 3


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 end of sentence, 6 comma and quotes, 7 symbols,
    8 beyond ASCII (first byte), 9 beyond ASCII (later bytes)."""
    out = np.zeros(256, np.uint8)
    for kind, chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t"), (5, b".?"), (6, b",;:'\"()-"), (7, b"!#$%&*+/<=>@[\\]^_`{|}~")):
        out[list(chars)] = kind
    out[0xC0:], out[0x80:0xC0] = 8, 9
    return out


_KIND = _kinds()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of all texts x OWN features of a line alone, bytes of each line, lines of each text."""
    data = [(t or "").encode() for t in texts]
    flat = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    ends = np.flatnonzero(flat == 10)
    starts = np.r_[0, ends[:-1] + 1]
    lines = np.array([d.count(b"\n") + 1 for d in data])
    doc = np.repeat(np.arange(len(data)), lines)
    kinds = _KIND[flat]
    sums = np.stack([np.add.reduceat((kinds == k).astype(np.int32), starts) for k in range(1, 9)], axis=1).astype(np.float64)
    size = (ends - starts).astype(np.float64)
    letters = np.maximum(size - sums[:, 3], 1)
    own = np.zeros((len(starts), OWN))
    own[:, :8] = sums / np.maximum(size, 1)[:, None]
    own[:, 8] = np.log1p(size)
    own[:, 9] = np.log1p(letters / (sums[:, 3] + 1))
    own[:, 10] = size == 0
    own[:, 11] = np.where(size > 0, _KIND[flat[np.maximum(ends - 1, 0)]] == 5, 0)
    words = np.maximum(sums[:, 3] + 1, 1)
    own[:, 12] = sums[:, 6] / words
    seen: dict = {}
    pieces = [x for d in data for x in d.split(b"\n")]
    for x in zip(doc.tolist(), pieces, strict=True):
        seen[x] = seen.get(x, 0) + 1
    own[:, 13] = np.log([seen[x] if x[1] else 1 for x in zip(doc.tolist(), pieces, strict=True)])
    own[:, 14] = [1 - len(set(ws)) / len(ws) if (ws := x.split()) else 0 for x in pieces]
    return own, size, lines


def _neighbours(lines: np.ndarray) -> np.ndarray:
    """For each line but the last, whether the next one belongs to the same text."""
    same = np.ones(max(0, lines.sum() - 1), bool)
    same[np.cumsum(lines)[:-1] - 1] = False
    return same


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Lines x FEATURES: those of the line, the line before, the line after; whether there are such; a constant."""
    out, same = np.zeros((len(own), FEATURES)), _neighbours(lines)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1] * same[:, None]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:] * same[:, None]
    out[1:, -3], out[:-1, -2], out[:, -1] = same, same, 1
    return out


def marginals(evidence: np.ndarray, lines: np.ndarray, join: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """evidence: log odds of good for each line, texts one after another; join: 2 x 2 transition weights.
    -> marginal of good for each line, sum of joint marginals of neighbours (2 x 2), log of all texts' partition sums."""
    order = np.argsort(-lines, kind="stable")
    begin = np.r_[0, np.cumsum(lines)[:-1]][order]
    count = lines[order]
    steps = int(count[0]) if len(count) else 0
    alive = np.searchsorted(-count, -np.arange(steps), "left")  # texts with more than t lines
    weight = np.exp(join)
    shift = np.abs(evidence) / 2
    emit = np.stack([np.exp(-evidence / 2 - shift), np.exp(evidence / 2 - shift)], axis=1)
    ahead, back = np.empty((len(evidence), 2)), np.ones((len(evidence), 2))
    log = shift.sum()
    state = np.ones((len(count), 2))
    for t in range(steps):
        n = alive[t]
        at = begin[:n] + t
        state = emit[at] * (state[:n] @ weight if t else state[:n])
        total = state.sum(axis=1, keepdims=True)
        state = state / total
        ahead[at] = state
        log += np.log(total).sum()
    joint = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        n = alive[t + 1]
        at = begin[:n] + t
        reach = emit[at + 1] * back[at + 1]
        value = reach @ weight.T
        pair = ahead[at][:, :, None] * weight * reach[:, None, :]
        joint += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[at] = value / value.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), joint, log


class Field:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, join: np.ndarray):
        self.mean, self.scale, self.weights, self.join = mean, scale, weights, join

    def evidence(self, own: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Log odds of good of each line: weights times scaled with_neighbours(), without writing these out."""
        plain, same = self.weights / self.scale, _neighbours(lines)
        out = own @ plain[:OWN] + plain[-1] - self.mean @ plain
        out[1:] += (own[:-1] @ plain[OWN : 2 * OWN] + plain[-3]) * same
        out[:-1] += (own[1:] @ plain[2 * OWN : 3 * OWN] + plain[-2]) * same
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        own, size, lines = line_features(texts)
        good, _, _ = marginals(self.evidence(own, lines), lines, self.join)
        weight, at = size + 1, np.r_[0, np.cumsum(lines)[:-1]]
        return np.clip(np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at), 0, 1)


def fit(texts: list[str | None], labels: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 1e-3) -> Field:
    """Climbs the likelihood of all lines having their document's label."""
    own, _, lines = line_features(texts)
    x = with_neighbours(own, lines)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    truth = np.repeat(labels, lines).astype(float)
    weights, join = np.zeros(FEATURES), np.zeros((2, 2))
    inner = _neighbours(lines)
    told = np.array([[((truth[:-1] == a) & (truth[1:] == b) & inner).sum() for b in (0, 1)] for a in (0, 1)], float)
    moments = [np.zeros(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        good, joint, _ = marginals(x @ weights, lines, join)
        gw = x.T @ (truth - good) / len(lines) - decay * weights
        gj = (told - joint) / len(lines) - decay * join
        for p, g, m, v in ((weights, gw, moments[0], moments[1]), (join, gj, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.clip(join, -4, 4, out=join)
    return Field(mean, scale, weights, join)


def _score(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 256, 500_000):
            scores = field.scores(batch.column("text").to_pylist()) if field else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return run


def held_out(folds: int = 5):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000) -> Field | None:
    """Learns labels.quality from whole texts of documents outside the held-out fold: `sample_rows` labels, and at most as
    many rows of documents that have one, each with the smallest hashes."""
    chosen = labels.filter(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    chosen = sampled(chosen, sample_rows).drop("h")
    rows = sampled(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sample_rows).collect()
    rows.sort(key=lambda r: r.h)
    known = np.array([int(r.quality) for r in rows])
    if len(set(known.tolist())) < 2:
        return None
    return fit([r.text for r in rows], known)


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(field), "doc_id long, score double")
