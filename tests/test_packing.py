"""Cut-offs, folds, ledgers, paths and streamed turns against plain versions on small rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.functions import paths
from ledgerloom.operators import packing, session
from ledgerloom.streaming import turns

SCHEMA = "k string, i long, n long"


def rows(seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, 0, 1, 5, 20, 99])) for i in range(120)]


def folded(data, most, budget, stop):
    out, held = set(), {}
    for k, i, n in sorted(data, key=lambda r: r[1]):
        count, total, over = held.get(k, (0, 0, False))
        fits = count < most and total + (n or 0) <= budget and not over
        if fits:
            out.add((k, i))
        held[k] = (count + fits, total + fits * (n or 0), over or (stop and not fits))
    return out


def test_skip_fold_and_prefix(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for most, budget in ((5, 30), (100, 60), (100, 10**9), (0, 5)):
        got = {(r.k, r.i) for r in packing.skip_fold(df, "k", F.col("n"), most, budget, "i").collect()}
        assert got == folded(data, most, budget, False)
        got = {(r.k, r.i) for r in packing.prefix_within(df, "k", F.coalesce("n", F.lit(0)), most, budget, "i").collect()}
        assert got == folded(data, most, budget, True)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", other string")
    assert packing.skip_fold(df, "k", F.col("n"), 3, 9, "i").columns == ["k", "i", "n", "other"]
    assert packing.skip_fold(df, "k", F.col("n"), 3, 9, "i").count() == packing.prefix_within(df, "k", F.col("n"), 3, 9, "i").count() == 0


def test_ledger(spark):
    df = spark.createDataFrame([("s", k, t) for t, k in enumerate([*range(300), *range(10)])], "s string, k long, t long")
    got = {r.k: (r.first, r.pos, r.held) for r in packing.ledger(df, "s", "k", "t").collect()}
    assert got == {k: (k, k + 1, k >= 300 - packing.LEDGER) for k in range(300)}


def test_paths(spark):
    cases = {"a/b.py": True, "/a": False, "a/../b": False, "..": False, "a\\b": False, "C:x": False, "": False, "x" * 201: False, "a..b": True, "a\nb": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.ok for r in df.select("p", paths.is_relative(F.col("p")).alias("ok")).collect()} == cases
    steps = {"a/./b//c": "a/b/c", "a/b/../c": "a/c", "../../x": "x", "": ""}
    df = spark.createDataFrame([(p,) for p in steps], "p string")
    assert {r.p: r.n for r in df.select("p", paths.normalised(F.col("p")).alias("n")).collect()} == steps


def test_streamed_turns_equal_batch(spark, tmp_path):
    rng, began = random.Random(5), datetime(2024, 1, 1)
    events = [(rng.randrange(6), began + timedelta(minutes=i), i, rng.choice(["signup", "view", "purchase", "error"])) for i in range(400)]
    schema = "user_id long, ts timestamp_ntz, event_id long, event_type string"
    for part in (events[:150], events[150:]):  # two files, one a batch, in order of time
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = sorted(map(tuple, turns.drained(turns.settled_turns(stream), "t").collect()))
    kind = F.col("event_type")
    numbered = session.numbered_turns(spark.createDataFrame(events, schema), "user_id", kind == "signup", "ts", "event_id")
    batch = numbered.groupBy("user_id", "turn_no").agg(F.count_if(kind == "view"), F.count_if(kind == "purchase")).collect()
    last = {u: max(r.turn_no for r in batch if r.user_id == u) for u in {r.user_id for r in batch}}
    assert got == sorted(tuple(r) for r in batch if r.turn_no < last[r.user_id])
