"""Context for a prompt: items packed into a budget of tokens, and what a session has been given."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import DIGITS, LETTERS, SIGN

# Least and most tokens of a budget, keys that a session's ledger holds.
LEAST, MOST, LEDGER = 80, 8000, 256
HEADER, NOTICE = "[Context of this repository. Check places in code.]", "Some context was left out to fit."
PACKED = "session string, text string, selected array<string>, omitted array<string>, tokens long"


def estimate(text: str) -> int:
    """Tokens of a text as functions.text.token_estimate counts them."""
    n = 0.0
    for piece in re.findall(r"[^\W\d_]+|\d+|\S", text):
        units = len(piece.encode("utf-16-le")) // 2
        n += math.ceil(units / LETTERS) if piece[0].isalpha() else math.ceil(units / DIGITS) if piece[0].isnumeric() else SIGN
    return math.ceil(n)


def fitted(items: list[tuple[str, str, float]], budget: int, characters: float = math.inf) -> tuple[str, list[str], list[str]]:
    """Items (key, text, priority) -> text, keys taken, keys left out: by priority and key, what fits with all before it is taken whole, what
    says the same as another is passed over; a notice says that something was left out, and takes the place of the last items if need be."""
    taken: list[tuple[str, str]] = []
    left, seen = [], set()
    fits = lambda text: estimate(text) <= budget and len(text) <= characters
    for key, text, _ in sorted(items, key=lambda x: (-x[2], x[0])):
        said = " ".join(unicodedata.normalize("NFKC", text).split())
        if said in seen:
            continue
        seen.add(said)
        if fits("\n\n".join([HEADER, *(t for _, t in taken), text])):
            taken.append((key, text))
        else:
            left.append(key)
    whole = lambda: "\n\n".join([HEADER, *(t for _, t in taken), *([NOTICE] if left else [])]) if taken or left else ""
    while taken and not fits(whole()):
        left.append(taken.pop()[0])
    return whole(), [k for k, _ in taken], left


def packed(items: DataFrame, budget: int = 2000, characters: float = math.inf) -> DataFrame:
    """items(session, key, text, priority) -> PACKED, one row for each session. A session's items make one prompt and meet in one place."""
    if not LEAST <= budget <= MOST:
        raise ValueError(f"a budget of {LEAST} to {MOST} tokens is supported")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        text, taken, left = fitted(list(zip(frame["key"], frame["text"], frame["priority"], strict=True)), budget, characters)
        return pd.DataFrame({"session": [frame["session"].iloc[0]], "text": [text], "selected": [taken], "omitted": [left], "tokens": [estimate(text)]})

    return items.select("session", "key", "text", "priority").groupBy("session").applyInPandas(one, PACKED)


def delivered(items: DataFrame, ledger: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items(session, key, ...), ledger(session, key, pos), valid(key) -> items that the session hasn't been given, keys to withdraw, each once (those of
    memories that are valid no more), and the ledger after it, its last LEDGER keys."""
    new = items.join(ledger.select("session", "key"), ["session", "key"], "left_anti")
    gone = ledger.filter(F.startswith("key", F.lit("memory:"))).join(valid.select("key"), "key", "left_anti").select("session", "key")
    kept = ledger.join(gone, ["session", "key"], "left_anti")
    after = kept.select("session", "key", F.lit(0).alias("late"), "pos").unionByName(new.select("session", "key").distinct().select("session", "key", F.lit(1).alias("late"), F.lit(0).cast("long").alias("pos")))
    order = W.partitionBy("session")
    after = after.withColumn("newest", F.row_number().over(order.orderBy(F.desc("late"), F.desc("pos"), F.desc("key")))).filter(F.col("newest") <= LEDGER)
    return new, gone, after.select("session", "key", F.row_number().over(order.orderBy(F.desc("newest"))).cast("long").alias("pos"))
