"""Packing and delivery of context."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import context


def test_estimates_agree(spark):
    said = ["hello world", "", "Éclair 12345 — x_y, ok!", "a" * 13 + "　b\xa0c", "日本語 ١٢٣ 😀!", "..,,;;" * 7]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.token_estimate(F.col("s")).alias("n"))
    assert {r.s: r.n for r in rows.collect()} == {s: context.estimate(s) for s in said}
    assert context.estimate("hello world") == 2


def test_items_are_taken_whole(spark):
    rows = [("s", "big", "word " * 400, 9.0), ("s", "small", "keep  this", 1.0), ("s", "same", "keep this", 0.5), ("t", "a", "only", 1.0)]
    items = spark.createDataFrame(rows, "session string, key string, text string, priority double")
    got = {r.session: r for r in context.packed(items, 100).collect()}
    assert (got["s"].selected, got["s"].omitted) == (["small"], ["big"]) and got["s"].text.endswith(context.NOTICE)
    assert got["t"].omitted == [] and context.NOTICE not in got["t"].text and got["t"].tokens <= 100
    for budget in (79, 8001):
        with pytest.raises(ValueError, match="budget"):
            context.packed(items, budget)
    assert context.fitted([], 100) == ("", [], [])
    tight = [(f"k{i}", "word " * 20, 1.0) for i in range(9)]
    whole, taken, left = context.fitted(tight, 100)
    assert context.estimate(whole) <= 100 and sorted(taken + left) == ["k0"] and left == []  # the others say the same


def test_a_key_is_given_once_and_withdrawn_once(spark):
    items = spark.createDataFrame([("s", "memory:a"), ("s", "code:b"), ("t", "memory:a")], "session string, key string")
    ledger = spark.createDataFrame([("s", "memory:a", 1), ("s", "memory:old", 2), ("s", "code:c", 3)], "session string, key string, pos long")
    valid = spark.createDataFrame([("memory:a",)], "key string")
    new, gone, after = context.delivered(items, ledger, valid)
    assert {tuple(r) for r in new.collect()} == {("s", "code:b"), ("t", "memory:a")} and [tuple(r) for r in gone.collect()] == [("s", "memory:old")]
    assert sorted(tuple(r) for r in after.collect()) == [("s", "code:b", 3), ("s", "code:c", 2), ("s", "memory:a", 1), ("t", "memory:a", 1)]
    again, gone, _ = context.delivered(items, after, valid)
    assert again.count() == gone.count() == 0
    many = spark.range(300).selectExpr("'s' as session", "concat('code:', id) as key", "id as pos")
    assert context.delivered(items.limit(0), many, valid)[2].count() == context.LEDGER
