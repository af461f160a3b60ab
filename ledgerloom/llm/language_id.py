"""Language of a text by a bidirectional gated recurrent network over bytes.

Sequences are the words of a text (runs without white space, lower-cased, without ASCII punctuation and digits at their
ends; runs over LONGEST bytes are read in parts of that size). The network labels every byte with a distribution over
languages, from what stands before and after it in its sequence. A document's distribution is the mean over all its
bytes. As states start anew with each word, a word's labels are the same wherever it stands and are worked out once per
worker.

Training: numpy, backpropagation through time, Adam, fixed seed, on a bounded sample: `sample_rows` documents of each
language, those with the smallest hashes, rows that repeat counted once, and of their whole texts `words_per_language` sequences, drawn at random (both
are parameters). So a rare language is learnt as well as a frequent one.

Texts of any length are read whole, one at a time. Null texts and texts without a letter are `und` with score 0, as is everything if nothing could be learnt (an empty
table, no language). Rows are handled one by one, so repeated or null doc_ids and further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hold_caches, sampled, small_slices

HIDDEN, LONGEST, REMEMBERED = 16, 48, 250_000
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One gated recurrent layer. Parameters: by byte `w` (256 x 3H: update, reset, candidate), recurrent `u` (H x 3H)."""

    def __init__(self, w: np.ndarray, u: np.ndarray):
        self.w, self.u = w, u

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        """x, mask: words x steps -> states, words x steps x H. keep: what backward() needs stays."""
        n, steps = x.shape
        k = self.u.shape[0]
        h, out, self.kept = np.zeros((n, k), np.float32), np.empty((n, steps, k), np.float32), []
        for t in range(steps):
            a, b = self.w[x[:, t]], h @ self.u
            gates = _sigmoid(a[:, : 2 * k] + b[:, : 2 * k])
            z, r, c = gates[:, :k], gates[:, k:], b[:, 2 * k :]
            new = np.tanh(a[:, 2 * k :] + r * c)
            m = mask[:, t : t + 1]
            if keep:
                self.kept.append((h, z, r, c, new, m))
            h = h + m * z * (new - h)
            out[:, t] = h
        return out

    def backward(self, x: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u from those of all states."""
        k, dw, du = self.u.shape[0], np.zeros_like(self.w), np.zeros_like(self.u)
        dh = np.zeros_like(gradient[:, 0])
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, c, new, m = self.kept[t]
            dh = dh + gradient[:, t]
            dz, dnew = dh * m * (new - h) * z * (1 - z), dh * m * z * (1 - new * new)
            dr = dnew * c * r * (1 - r)
            da = np.concatenate([dz, dr, dnew], axis=1)
            db = np.concatenate([dz, dr, dnew * r], axis=1)
            np.add.at(dw, x[:, t], da)
            du += h.T @ db
            dh = dh * (1 - m * z) + db @ self.u.T
        return dw, du


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng, self.languages = np.random.default_rng(seed), languages
        normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.parameters = [normal(256, 3 * hidden), normal(hidden, 3 * hidden), normal(256, 3 * hidden), normal(hidden, 3 * hidden), normal(2 * hidden, len(languages)), np.zeros(len(languages), np.float32)]

    @staticmethod
    def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of words, the same from their ends, and which places are real."""
        sizes = np.array([len(w) for w in words])
        mask = np.arange(sizes.max()) < sizes[:, None]
        x, back = np.zeros(mask.shape, np.int64), np.zeros(mask.shape, np.int64)
        x[mask] = np.frombuffer(b"".join(words), np.uint8)
        back[mask] = np.frombuffer(b"".join([w[::-1] for w in words]), np.uint8)
        return x, back, mask

    @staticmethod
    def turned(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Places from the end -> places from the start, and the other way round."""
        at = np.maximum(mask.sum(axis=1)[:, None] - 1 - np.arange(mask.shape[1]), 0)
        return np.take_along_axis(values, at[:, :, None], axis=1)

    def labels(self, words: list[bytes], keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Distribution over languages at every place (words x steps x languages), and which places are real."""
        wf, uf, wb, ub, wo, bo = self.parameters
        x, back, mask = self.padded(words)
        real = mask.astype(np.float32)
        self.ahead, self.behind = Direction(wf, uf), Direction(wb, ub)
        self.states = np.concatenate([self.ahead.forward(x, real, keep), self.turned(self.behind.forward(back, real, keep), mask)], axis=2)
        logits = self.states @ wo + bo
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True), mask

    def gradients(self, words: list[bytes], target: np.ndarray) -> list[np.ndarray]:
        p, mask = self.labels(words, keep=True)
        x, back, _ = self.padded(words)
        d = p.copy()
        d[np.arange(len(words)), :, target] -= 1
        d *= mask[:, :, None] / mask.sum()
        d = d.astype(np.float32)
        flat, states = d.reshape(-1, d.shape[2]), self.states.reshape(-1, self.states.shape[2])
        ds = d @ self.parameters[4].T
        k = ds.shape[2] // 2
        ahead = self.ahead.backward(x, ds[:, :, :k])
        behind = self.behind.backward(back, self.turned(ds[:, :, k:], mask) * mask[:, :, None])
        return [*ahead, *behind, states.T @ flat, flat.sum(axis=0)]

    def fit(self, words: list[bytes], target: np.ndarray, epochs: int = 8, size: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
        rng, step = np.random.default_rng(seed), 0
        first, second = ([np.zeros_like(p) for p in self.parameters] for _ in range(2))
        steps = epochs * -(-len(words) // size)
        for _ in range(epochs):
            order = rng.permutation(len(words))
            for i in range(0, len(words), size):
                at = order[i : i + size]
                step += 1
                now = rate * (1 - step / (steps + 1))
                for p, g, m, v in zip(self.parameters, self.gradients([words[j] for j in at], target[at]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def sums(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum of its places' distributions, then the number of places."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for i in range(0, len(words), 2048):
            at = order[i : i + 2048]
            p, mask = self.labels([words[j] for j in at])
            out[at, :-1], out[at, -1] = (p * mask[:, :, None]).sum(axis=1), mask.sum(axis=1)
        return out


def sequences(word: str) -> list[bytes]:
    """The byte sequences of a word; none if it has no letter."""
    word = word.strip(_EDGES)
    if not any(map(str.isalpha, word)):
        return []
    data = word.encode()
    return [data[i : i + LONGEST] for i in range(0, len(data), LONGEST)]


class Labeller:
    """Word -> row of a growing table of sums."""

    def __init__(self, network: Network):
        self.network, self.rows, self.plain, self.used = network, {}, {}, 0
        self.table = np.zeros((1024, len(network.languages) + 1), np.float32)

    def add(self, words: list[str]) -> None:
        """Rows for new words; words that differ only at their ends share one."""
        plain = [w.strip(_EDGES) for w in words]
        new = list({p for p in plain if p not in self.plain})
        parts = [sequences(p) for p in new]
        sums = self.network.sums([s for p in parts for s in p]) if any(parts) else np.zeros((0, self.table.shape[1]), np.float32)
        if self.used + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((self.used + len(new), self.table.shape[1]), np.float32)])
        at = 0
        for word, p in zip(new, parts, strict=True):
            self.table[self.used] = sums[at : at + len(p)].sum(axis=0)
            self.plain[word] = self.used
            self.used += 1
            at += len(p)
        for word, p in zip(words, plain, strict=True):
            self.rows[word] = self.plain[p]

    def documents(self, texts: list[str | None]) -> np.ndarray:
        if len(self.rows) > REMEMBERED:
            self.rows, self.plain, self.used = {}, {}, 0
        lists = [(t or "").lower().split() for t in texts]
        new = list({w for ws in lists for w in ws if w not in self.rows})
        if new:
            self.add(new)
        get = self.rows.__getitem__
        return np.array([self.table[list(map(get, ws))].sum(axis=0, dtype=np.float64) if ws else np.zeros(self.table.shape[1]) for ws in lists])


_LABELLERS: dict[bytes, Labeller] = {}


def _predict(network: Network | None, label: str, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("language", _LABELLERS.clear)
        key = b"".join(p.tobytes() for p in network.parameters) if network else b""
        if network and key not in _LABELLERS:
            _LABELLERS.clear()
            _LABELLERS[key] = Labeller(network)
        for batch in small_slices(batches, 128, 1_000_000):
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if network:
                sums = _LABELLERS[key].documents(batch.column("text").to_pylist())
                share, known = sums[:, :-1] / np.maximum(sums[:, -1:], 1), sums[:, -1] > 0
                langs = [network.languages[x] if k else "und" for x, k in zip(share.argmax(axis=1).tolist(), known.tolist(), strict=True)]
                scores = np.where(known, np.minimum(share.max(axis=1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, label, score])

    return run


def held_out(folds: int = 4, fold: int = 2):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def train(docs: DataFrame, sample_rows: int = 1000, words_per_language: int = 6000) -> Network | None:
    """Learns from docs(doc_id, text, lang) outside the held-out fold: from whole texts of at most `sample_rows` documents of each
    language, and of these from `words_per_language` sequences, drawn with a fixed seed. The same rows give the same network."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = sampled(rows, sample_rows, "lang").collect()
    rows.sort(key=lambda r: (r.h, r.lang))
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    rng, words, target = np.random.default_rng(11), [], []
    for i, lang in enumerate(languages):
        own = [s for r in rows if r.lang == lang for w in r.text.lower().split() for s in sequences(w)]
        if own:
            chosen = [own[j] for j in rng.integers(0, len(own), words_per_language)]
            words += chosen
            target += [i] * len(chosen)
    return Network(languages).fit(words, np.array(target)) if words else None


def predict(docs: DataFrame, network: Network | None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs(doc_id, text, ...) -> the same rows and columns, and a label and a score under these names. A column that has
    one of the names already is replaced."""
    docs = docs.drop(label, score).withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(_predict(network, label, score), T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())]))
