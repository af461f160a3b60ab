"""Verdicts and retention: ids that don't repeat, state that ends, restarts, late and repeated rows."""

from pyspark.sql import functions as F

from ledgerloom.streaming import retention, verdicts

EVENTS = "session string, id string, kind string, correction boolean, at timestamp"
CAPTURES = "session string, id string, kind string, refs array<string>, working array<string>, at timestamp"
DAY = 24 * 3600


def put(spark, folder, name, rows, schema):
    names = schema.rsplit(",", 1)[0] + ", second double"
    df = spark.createDataFrame([(*r[:-1], float(r[-1])) for r in rows], names).withColumn("at", F.timestamp_seconds("second")).drop("second")
    df.coalesce(1).write.parquet(f"{folder}/in/{name}")


def run(spark, folder, made, schema):
    """One start of the query over what is there now."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in/*")
    made(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_verdicts_step_by_step():
    state, out = (None, None, 0), []
    for at, kind, correction in ((0, "verdict", True), (1, "prompt", None), (2, "edit", None), (3, "prompt", None), (4, "verdict", False), (5, "verdict", True), (6, "prompt", None), (7, "prompt", None), (8, "verdict", True), (9, "prompt", None), (80, "edit", None), (81, "verdict", False), (82, "end", None), (83, "end", None)):
        state, settled = verdicts.step(state, at * 1000, f"e{at}", kind, correction)
        out += settled
    assert out == [("e1", "no_correction"), ("e3", "withheld"), ("e6", "correction"), ("e7", "withheld"), ("e9", "session_end")]


def test_verdicts_come_once_over_restarts_and_resumed_sessions(spark, tmp_path):
    go = lambda: run(spark, tmp_path, verdicts.verdicts, EVENTS)
    put(spark, tmp_path, "a", [("s", "p1", "prompt", None, 1), ("s", "p2", "prompt", None, 3), ("s", "v1", "verdict", True, 4), ("s", "v1", "verdict", True, 4)], EVENTS)
    go()
    put(spark, tmp_path, "b", [("s", "p3", "prompt", None, 5), ("t", "q1", "prompt", None, 500), ("s", "p3", "prompt", None, 5)], EVENTS)
    go()
    put(spark, tmp_path, "c", [("t", "q2", "end", None, 501), ("s", "late", "verdict", True, 2)], EVENTS)  # the last row is late
    go()
    put(spark, tmp_path, "d", [("t", "q3", "prompt", None, 600), ("t", "q4", "end", None, 601), ("s", "x", "end", None, 602)], EVENTS)  # sessions go on
    got = sorted((r.session, r.turn, r.verdict) for r in go().collect())
    assert got == [("s", "p1", "correction"), ("s", "p2", "withheld"), ("s", "p3", "session_end"), ("t", "q1", "session_end"), ("t", "q3", "session_end")]
    ids = [r.id for r in go().collect()]
    assert len(ids) == len(set(ids)) == 5


def test_an_idle_session_leaves_no_state(spark, tmp_path):
    go = lambda: run(spark, tmp_path, verdicts.verdicts, EVENTS)
    put(spark, tmp_path, "a", [("s", "p1", "prompt", None, 1), ("s", "p2", "prompt", None, 10)], EVENTS)
    put(spark, tmp_path, "b", [("t", "q1", "prompt", None, 8 * DAY)], EVENTS)
    put(spark, tmp_path, "c", [("s", "p3", "prompt", None, 8 * DAY + 100), ("s", "p4", "end", None, 8 * DAY + 101)], EVENTS)
    got = sorted((r.session, r.turn, r.verdict) for r in go().collect())
    assert got == [("s", "p1", "withheld"), ("s", "p3", "session_end")]  # p2 was open when the session's state went
    left = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "turns").load(f"{tmp_path}/state")
    assert [r.key.session for r in left.select("key").collect()] == ["t"]


def test_texts_go_when_nothing_needs_them(spark, tmp_path):
    go = lambda: {(r.session, r.id, r.reason) for r in run(spark, tmp_path, retention.erasable, CAPTURES).collect()}
    first = [("s", "p1", "prompt", None, None, 1), *(("s", f"c{i}", "other", None, None, 1 + i / 2) for i in range(1, 9)), ("s", "p2", "prompt", None, None, 9)]
    put(spark, tmp_path, "a", [*first, ("s", "x1", "extracted", ["p1", *(f"c{i}" for i in range(1, 9)), "p2"], ["c2"], 10)], CAPTURES)
    assert go() == {("s", i, "extracted") for i in ("p1", "c1", "c3")}  # c2 is quoted, the last six are context, p2 waits for p1's verdict
    put(spark, tmp_path, "b", [("s", "x2", "settled", ["p1"], None, 11), ("s", "c9", "other", None, None, 12), ("s", "x3", "extracted", ["c9"], [], 13)], CAPTURES)
    assert go() == {("s", i, "extracted") for i in ("p1", "c1", "c2", "c3", "c4")}
    put(spark, tmp_path, "c", [("s", "z", "end", None, None, 14), ("s", "x4", "extracted", ["z"], [], 15), ("s", "x5", "settled", ["p2"], None, 16), ("u", "k", "other", None, None, 17)], CAPTURES)
    done = go()
    assert {i for s, i, r in done if s == "s"} == {"p1", "p2", "z", *(f"c{i}" for i in range(1, 10))} and len(done) == 12
    assert {r for s, i, r in done if i in ("p2", "z", "c9")} == {"complete"}
    put(spark, tmp_path, "d", [("w", "m", "other", None, None, 8 * DAY)], CAPTURES)
    assert go() - done == {("u", "k", "stale")}
