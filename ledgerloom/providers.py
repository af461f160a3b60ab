"""What a service may decide, as functions that can be exchanged, each with a default that needs no service.

A provider takes and gives DataFrames. Answers of services are checked for shape before they count. Models are optional: where there is none, vectors
are null and everything falls back on words."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text

# Lines of the reading service, texts of one request, characters of a message, what makes a lesson hard, new rules linked and candidates of each.
LINE, LOW, BATCH, MESSAGE, CONFIDENT, SESSIONS, NEW_RULES, CANDIDATES = 0.56, 0.45, 64, 1500, 0.6, 2, 12, 8
DIMENSIONS = 64
_CORRECTION = re.compile(r"\b(no|not|wrong|instead|non|plutôt|pas)\b", re.IGNORECASE)


def rank(rows: DataFrame, message: str) -> DataFrame:
    """idx, content -> idx, score: the share of the message's words that a rule holds."""
    asked = rows.sparkSession.createDataFrame([(message[:MESSAGE],)], "m string").select(F.array_distinct(text.tokens(F.col("m"))).alias("q"))
    both = rows.crossJoin(F.broadcast(asked))
    return both.select("idx", (F.size(F.array_intersect(text.tokens(F.col("content")), F.col("q"))) / F.greatest(F.lit(1), F.size("q"))).cast("double").alias("score"))


def hashed_vector(said: str | None) -> list[float] | None:
    """Words counted in DIMENSIONS places by their hash, at length 1; null for a text without words."""
    out = [0.0] * DIMENSIONS
    for w in re.findall(r"\w+", (said or "").lower()):
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        out[h[0] % DIMENSIONS] += 1 if h[1] % 2 else -1
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else None


def embed(rows: DataFrame, one: Callable[[list[str]], list[list[float] | None]] | None = None) -> DataFrame:
    """id, content -> id, vec: a model's vectors for batches of BATCH texts, or hashed ones. A model that gives another number of vectors is an error."""
    model = one or (lambda texts: [hashed_vector(t) for t in texts])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), BATCH):
                part = frame.iloc[i : i + BATCH]
                vectors = model(part["content"].tolist())
                if len(vectors) != len(part) or len({len(v) for v in vectors if v is not None}) > 1:
                    raise ValueError("a vector of one length for each text is needed")
                yield pd.DataFrame({"id": part["id"], "vec": vectors})

    return rows.select("id", "content").mapInPandas(run, "id string, vec array<float>")


def no_model(texts: list[str]) -> list[None]:
    """A local model that is not there."""
    return [None] * len(texts)


def eligible(events: DataFrame) -> DataFrame:
    """version, turn, session, corrected of confirmations -> version, confidence, eligible: confirmed in enough turns and sessions; a correction counts as two."""
    rows = events.groupBy("version").agg(F.countDistinct("turn").alias("turns"), F.countDistinct("session").alias("sessions"), F.coalesce(F.bool_or("corrected"), F.lit(False)).alias("corrected"))
    c = F.col("turns") + F.when(F.col("corrected"), 2).otherwise(0)
    return rows.select("version", (c / (c + 2)).alias("confidence"), "sessions").withColumn("eligible", (F.col("confidence") >= CONFIDENT) & (F.col("sessions") >= SESSIONS)).drop("sessions")


def extract(events: DataFrame) -> DataFrame:
    """id, content -> event_id, content of what is marked as a decision, one row for each line."""
    lines = events.select(F.col("id").alias("event_id"), F.explode(F.split("content", "\n")).alias("line"))
    said = F.trim(F.regexp_extract("line", r"DECISION:\s*(.+)$", 1))
    return lines.select("event_id", said.alias("content")).filter("content <> ''")


def correction(message: str) -> tuple[bool, str | None]:
    """Whether a message corrects, and the sentence of it that explains; an explanation is always part of the message."""
    for sentence in re.split(r"(?<=[.!?])\s+", message):
        if _CORRECTION.search(sentence):
            return True, sentence
    return False, None


def checked_correction(message: str, answer: tuple[bool, str | None]) -> tuple[bool, str | None]:
    """A service's answer; an explanation that the message doesn't hold is left out."""
    said, why = answer
    return bool(said), why if why and why in message else None


def link(pairs: DataFrame) -> DataFrame:
    """a, b, near (pairs of a rule and one close to it) -> a, b, kind: the same words replace a rule, an exception says so, others near by are read along."""
    same = text.normalised(F.col("a_content")) == text.normalised(F.col("b_content"))
    kind = F.when(same, "supersedes").when(F.col("a_content").rlike(r"(?i)\b(except|unless|sauf)\b"), "exception_to").when(F.col("near") >= LINE, "read_with")
    return pairs.select("a", "b", kind.alias("kind")).filter("kind is not null")


@dataclass
class Registry:
    """The functions in use, by the name of what they decide."""

    functions: dict[str, Callable] = field(default_factory=lambda: {"rank": rank, "embed": embed, "sentences": no_model, "reading": no_model, "context": eligible, "extract": extract, "correction": correction, "link": link})

    def use(self, name: str, function: Callable) -> None:
        if name not in self.functions:
            raise KeyError(f"nothing is decided under {name}")
        self.functions[name] = function

    def __getitem__(self, name: str) -> Callable:
        return self.functions[name]


def register(spark: SparkSession) -> list[str]:
    """SQL functions for sessions: scalar ones as vectorised functions, so that SQL can use what the package has."""
    scalar = F.pandas_udf(lambda s: s.map(hashed_vector), "array<float>")
    spark.udf.register("hashed_vector", scalar)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)")
    return ["hashed_vector", "cosine"]
