"""Stores, checks, history, verdicts, providers."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import providers
from ledgerloom.operators import history, validation
from ledgerloom.sources import knowledge
from ledgerloom.streaming import sinks, verdicts

AT = "2026-05-01T00:00:00Z"


def version(i, number=1, previous=None, knowledge_id=None, content=None, **other):
    row = {"id": i, "knowledge_id": knowledge_id or i, "version": number, "previous_version_id": previous, "kind": "decision", "state": "active", "content": content or f"About {i}.", "zones": [], "source_ids": ["s1"], "event_ids": ["e1"], "recorded_at": "2026-01-01T00:00:00Z", "valid_from": None, "valid_until": None}
    return row | other


def relation(i, kind, a, b, **other):
    return {"id": i, "kind": kind, "from": {"type": "version", "id": a}, "to": {"type": "version", "id": b}, "source_ids": ["s1"], "recorded_at": "2026-01-02T00:00:00Z", "valid_from": None, "valid_until": None} | other


def store():
    return {
        "sources": [{"id": "s1", "kind": "document", "reference": "r", "revision": None, "content": "We use the gateway.", "recorded_at": "2026-01-01T00:00:00Z"}],
        "events": [{"id": "e1", "kind": "observation", "source_ids": ["s1"], "actor": None, "session_id": "x", "occurred_at": None, "recorded_at": "2026-01-01T00:00:00Z", "content": "We use the gateway."}],
        "versions": [version("gateway", content="Calls go through the gateway."), version("network"), version("contract"), version("incident"), version("v2", 2, "gateway", "gateway", recorded_at="2026-06-01T00:00:00Z")],
        "relations": [relation("why-network", "motivated_by", "gateway", "network"), relation("why-contract", "motivated_by", "network", "contract"), relation("back", "motivated_by", "contract", "gateway"), relation("against", "contradicts", "incident", "gateway"), relation("other", "alternative_to", "gateway", "contract"), relation("late", "supported_by", "gateway", "incident", recorded_at="2026-07-01T00:00:00Z")],
    }


def frames(spark, data=None):
    data = data or store()
    return {n: spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", knowledge.STORE[n]).alias("r")).select("r.*") for n, rows in data.items()}


def problems(spark, change):
    data = store()
    change(data)
    return {(r.record, r.id, r.problem) for r in validation.problems(frames(spark, data)).collect()}


def test_checks_find_what_is_wrong(spark):
    assert problems(spark, lambda d: None) == set()
    assert problems(spark, lambda d: d["versions"][0].update(valid_from="2026-02-02T00:00:00Z", valid_until="2026-02-01T00:00:00Z", state="odd")) == {("versions", "gateway", "validity interval"), ("versions", "gateway", "kind, state or content")}
    assert problems(spark, lambda d: d["versions"][4].update(previous_version_id="network")) == {("versions", "v2", "version chain")}
    assert problems(spark, lambda d: (d["relations"][0]["to"].update(id="gone"), d["relations"][1].update(source_ids=["s9"]))) == {("relations", "why-network", "dangling relation"), ("relations", "why-contract", "unknown source")}
    assert problems(spark, lambda d: d["sources"].append(d["sources"][0] | {"recorded_at": "soon"})) == {("sources", "s1", "duplicate id"), ("sources", "s1", "id or date")}


def test_a_store_is_imported_exported_and_never_rewritten(spark, tmp_path):
    (tmp_path / "store.json").write_text(json.dumps(store()))
    path = f"{tmp_path}/store"
    assert knowledge.import_store(spark, f"{tmp_path}/store.json", path) == {"sources": 1, "events": 1, "versions": 5, "relations": 6}
    assert knowledge.import_store(spark, f"{tmp_path}/store.json", path) == {"sources": 0, "events": 0, "versions": 0, "relations": 0}
    assert knowledge.store_status(spark, path) == {"sources": 1, "events": 1, "versions": 5, "relations": 6, "knowledge": 4}
    with pytest.raises(ValueError, match="other contents"):
        knowledge.append_records(spark, path, {"versions": frames(spark)["versions"].withColumn("content", F.lit("x"))})
    (tmp_path / "bad.json").write_text(json.dumps(store() | {"events": []}))
    with pytest.raises(ValueError, match="unknown event"):
        knowledge.import_store(spark, f"{tmp_path}/bad.json", f"{tmp_path}/none")
    knowledge.export_store(spark, path, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/versions").count() == 5
    assert knowledge.erase_contents(spark, path, spark.createDataFrame([("e1",)], "id string")) == 1
    assert [r.content for r in knowledge.load_store(spark, path)["events"].collect()] == [""] and knowledge.store_status(spark, path)["versions"] == 5
    assert not any(b"gateway" in p.read_bytes() for p in (tmp_path / "store" / "data").glob("events-*/*.parquet"))


def test_index_revision_follows_contents(spark, tmp_path):
    modules = spark.createDataFrame([("a.ts", ["x"], [], 3, 0, [])], knowledge.MODULES)
    routes = spark.createDataFrame([], knowledge.ROUTES)
    assert knowledge.revision(*knowledge.load_index(spark, f"{tmp_path}/none")) == "unsaved"
    first = knowledge.save_index(modules, routes, f"{tmp_path}/i")
    assert knowledge.save_index(modules, routes, f"{tmp_path}/i") == first != knowledge.save_index(modules.withColumn("loc", F.lit(4)), routes, f"{tmp_path}/i")
    assert knowledge.uploaded(modules).first().exports == ["x"]


def test_vectors_backups_logs_and_pages(spark, tmp_path):
    one = spark.createDataFrame([("k", 1, "m", [1.0])], "knowledge_id string, version long, model string, vec array<float>")
    knowledge.upsert_vectors(spark, f"{tmp_path}/none", one, f"{tmp_path}/v1")
    two = knowledge.upsert_vectors(spark, f"{tmp_path}/v1", one.withColumn("vec", F.array(F.lit(2.0).cast("float"))).unionByName(one.withColumn("version", F.lit(0))), f"{tmp_path}/v2")
    assert [tuple(r) for r in two.collect()] == [("k", 1, "m", [2.0])]
    (tmp_path / "t.bin").write_bytes(knowledge.vector_table([("Été", [1, -2]), ("ete", [3, 4]), ("b", [5, 6])], 2))
    (tmp_path / "t.txt").write_text("Été\nete\nb\n")
    assert {r.word: r.vec for r in knowledge.read_vector_table(spark, f"{tmp_path}/t.bin", f"{tmp_path}/t.txt").collect()} == {"ete": [1, -2], "b": [5, 6]}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.txt").write_text("hello")
    assert knowledge.backup(spark, f"{tmp_path}/f", f"{tmp_path}/b") == 1
    assert [(r.path, bytes(r.content)) for r in knowledge.restored(spark, f"{tmp_path}/b").collect()] == [("x.txt", b"hello")]
    log = spark.createDataFrame([("2026-01-01 10:00:00", "s", "first"), ("2026-01-02 10:00:00", "s", "second")], "at string, session string, text string").withColumn("at", F.to_timestamp("at"))
    knowledge.append_injection(spark, f"{tmp_path}/log", log)
    assert knowledge.last_injections(spark, f"{tmp_path}/log", 8) == ["second"]
    pages = spark.createDataFrame([(i, "version", json.dumps({"n": i})) for i in range(5)], "seq int, type string, record string")
    page, cursor, more = knowledge.pulled(pages, 0, 3)
    assert ([p["record"]["n"] for p in page], cursor, more) == ([1, 2, 3], 3, True) and knowledge.pulled(pages, 4, 3) == ([], 4, False)
    records = spark.createDataFrame([('{"b":1,"a":2}', "https://h.org/t/r/1"), ('{"a":2, "b":1}', "https://h.org/t/r/2"), ("{}", "https://h.org/other/r/2")], "record string, url string")
    new = knowledge.new_page_records(records, spark.createDataFrame([], "id string"), "h.org/t/r")
    assert [r.content for r in new.collect()] == ['{"a":2,"b":1}']
    lines = spark.createDataFrame([('{"a": 1}',), ("x" * (knowledge.HOOK_BYTES + 1),)], "value string")
    assert [r.a for r in knowledge.hook_inputs(lines, "a int").collect()] == [1]
    captures = spark.createDataFrame([("s", "e2", "2026", "/x/e2.json"), ("s", "e1", "2025", "/x/e1.json"), ("s", "e3", "2024", "/x/odd.json")], "session_id string, event_id string, recorded_at string, file string")
    assert [r.event_id for r in knowledge.session_events(captures, "s").collect()] == ["e1", "e2"]
    assert [tuple(r) for r in knowledge.sessions(captures).collect()] == [("s", 3, "2026")]


def test_history_of_a_version(spark):
    t = frames(spark)
    seen = history.visible(t["relations"], t["versions"], t["events"], t["sources"], AT)
    assert {r.id for r in seen.collect()} == {"why-network", "why-contract", "back", "against", "other"}
    reasons, cut = history.why(seen, "gateway")
    assert [(r.relation, r.level, r.cycle) for r in reasons.orderBy("level").collect()] == [("why-network", 1, False), ("why-contract", 2, False), ("back", 3, True)] and not cut
    assert history.why(seen, "gateway", 1)[1]
    assert {(r.part, r.other) for r in history.around(seen, "gateway").collect()} == {("counterexample", "incident"), ("alternative", "contract")}
    assert [r.id for r in history.resolved(t["versions"], "why the gateway calls", AT).collect()] == ["gateway"]
    assert history.resolved(t["versions"], "about", AT).count() == 3 and history.resolved(t["versions"], "why", AT).count() == 0
    assert [r.id for r in history.heads(t["versions"], "2026-06-02T00:00:00Z").filter("knowledge_id = 'gateway'").collect()] == ["v2"]
    whole = history.history(t["versions"], t["relations"], t["events"], t["sources"], "gateway", AT)
    assert {n: r.count() for n, r in whole.items()} == {"versions": 1, "relations": 4, "events": 1, "sources": 1}
    near = history.neighbourhood(t["versions"], t["relations"], t["events"], "gateway")
    assert near["versions"].count() == 5
    scores = spark.createDataFrame([("gateway", 0.9), ("network", 0.8), ("contract", 0.1), ("incident", 0.4)], "id string, score double")
    found = history.investigated(seen, spark.createDataFrame([("gateway",)], "id string"), scores)
    assert {(r.id, r.round) for r in found.collect()} == {("gateway", 0), ("network", 1), ("incident", 1)}


def test_records_of_others_and_what_is_learnt(spark):
    t = frames(spark)["versions"]
    head = t.filter("id = 'v2'").first()
    rows = [(1, "a", "gateway", "active", head.content, []), (2, "b", "gateway", "active", "new", []), (3, "c", "gateway", "active", "new", []), (4, "network", "network", "active", "x", []), (5, "d", "fresh", "active", "y", [])]
    got = history.adopted(t, spark.createDataFrame(rows, "seq int, id string, knowledge_id string, state string, content string, zones array<string>"))
    assert sorted((r.id, r.version, r.previous_version_id) for r in got.collect()) == [("b", 3, "v2"), ("d", 1, None)]
    items = spark.createDataFrame([("network", "decision", "ABOUT network", "e1"), ("gateway", "decision", "Now by queue.", "e1")], "knowledge_id string, kind string, content string, event_id string")
    new, proofs = history.applied(items, t)
    assert [(r.knowledge_id, r.version, r.previous_version_id) for r in new.collect()] == [("gateway", 3, "v2")] and proofs.count() == 1
    learnt = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3), ("w", 4)], "id string, turn int")
    verdict = spark.createDataFrame([(1, "correction"), (2, "withheld"), (3, "no_correction")], "turn int, verdict string")
    assert {r.id: r.state for r in history.born(learnt, verdict).collect()} == {"x": "contested", "z": "active", "w": "proposed"}


def test_lessons_traces_and_quotes(spark):
    events = spark.createDataFrame([("e1", "s", "error_observed", "it broke here"), ("e2", "s", "observation", "use a lock"), ("e3", "other", "observation", "use a lock")], "id string, session_id string, kind string, content string")
    lesson = "id string, session_id string, event_ids array<string>, content string, proofs array<struct<event_id:string,quote:string>>, error_event_id string"
    rows = [("good", "s", ["e1", "e2"], "use a lock", [("e1", "it broke"), ("e2", "use a lock")], "e1"), ("far", "s", ["e1", "e3"], "use a lock", [("e3", "use a lock")], "e1"), ("long", "s", ["e1"], "x", [("e1", "x" * 601)], "e2")]
    got = {(r.id, r.problem) for r in validation.unproven_lessons(spark.createDataFrame(rows, lesson), events).collect()}
    assert got == {("far", "quote"), ("long", "quote"), ("long", "content"), ("long", "resolution")}
    traces = spark.createDataFrame([("k1", "e1", "broke", None), ("k2", "e1", "fixed", "k1"), ("k3", "e9", "x", None), ("k4", "e2", "lock", "k9")], "key string, event_id string, quote string, parent string")
    none = spark.createDataFrame([], "key string, fingerprint string")
    new, wrong = validation.recorded_traces(traces, events, none)
    assert [r.key for r in new.collect()] == ["k1"] and {(r.key, r.problem) for r in wrong.collect()} == {("k2", "quote"), ("k3", "unknown event"), ("k4", "unknown parent")}
    again, used = validation.recorded_traces(traces.limit(1), events, new.select("key", "fingerprint"))
    assert again.count() == used.count() == 0
    quotes = spark.createDataFrame([("q1", "s1", "the gateway"), ("q2", "s1", "The gateway."), ("q3", "s1", "no such"), ("q4", "s1", "We use")], "key string, source_id string, quote string")
    source = spark.createDataFrame([("s1", "We use the gateway. The gateway. No.")], "id string, content string")
    stored = spark.createDataFrame([("q9", "we  USE")], "key string, content string")
    assert [r.key for r in validation.remembered(quotes, source, stored).collect()] == ["q1"]


def test_windows_of_a_table(spark):
    rows = spark.createDataFrame([(60 * m, "a") for m in (0, 5, 40, 70)], "s long, kind string").select(F.timestamp_seconds("s").alias("at"), "kind")
    got = {k: sorted(r.n for r in df.collect()) for k, df in verdicts.windows(rows).items()}
    assert got == {"fixed": [1, 3], "sliding": [1, 2, 2, 3], "session": [1, 1, 2]}


def test_sinks(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.txt").write_text("x")
    seen = []
    for _ in range(2):
        sinks.watch(spark, f"{tmp_path}/w", f"{tmp_path}/ws", lambda files: seen.append(files.count()), None).awaitTermination()
    assert seen == [1]
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string").write.parquet(f"{tmp_path}/rows")
    for k in "xy":
        stream = spark.readStream.schema("id int, v string").parquet(f"{tmp_path}/rows")
        sinks.appended(stream, "id", f"{tmp_path}/t", f"{tmp_path}/s{k}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    operations = spark.range(450).select(F.col("id"), (F.col("id") * 7).alias("seq"))
    got = sinks.chunks(operations, spark.range(50))
    assert got.count() == 400 and max(r["count"] for r in got.groupBy("push").count().collect()) <= sinks.CHUNK
    order = [r.push for r in got.orderBy("seq").collect()]
    assert order == sorted(order) and sinks.chunks(operations, operations).count() == 0
    turn = iter(("1", "2"))
    now = ["0"]

    def write(revision, _):
        now[0] = next(turn)
        return revision == "1"

    assert sinks.committed(lambda: (now[0], operations), lambda t: t, write).count() == 450
    with pytest.raises(sinks.Conflict):
        sinks.committed(lambda: ("0", operations), lambda t: t, lambda *_: False)


def test_providers(spark):
    rows = spark.createDataFrame([(0, "archive export"), (1, "logger")], "idx int, content string")
    assert [r.score for r in providers.rank(rows, "An archive export").orderBy("idx").collect()] == [1.0, 0.0]
    texts = spark.createDataFrame([("a", "one two"), ("b", None)], "id string, content string")
    got = {r.id: r.vec for r in providers.embed(texts).collect()}
    assert len(got["a"]) == providers.DIMENSIONS and got["b"] is None
    assert all(r.vec is None for r in providers.embed(texts, providers.no_model).collect())
    events = spark.createDataFrame([("v", f"t{i}", f"s{i % 2}", False) for i in range(3)] + [("w", "t", "s", True)], "version string, turn string, session string, corrected boolean")
    assert {r.version: (round(r.confidence, 2), r.eligible) for r in providers.eligible(events).collect()} == {"v": (0.6, True), "w": (0.6, False)}
    said = spark.createDataFrame([("e", "x\nDECISION: use it\nDECISION:  ")], "id string, content string")
    assert [r.content for r in providers.extract(said).collect()] == ["use it"]
    assert providers.correction("Good. Not that way! Ok.") == (True, "Not that way!") and providers.correction("Fine.") == (False, None)
    assert providers.checked_correction("abc", (True, "zzz")) == (True, None)
    pairs = spark.createDataFrame([("a", "b", "X y", "x  y.", 0.1), ("a", "c", "all except z", "q", 0.1), ("a", "d", "m", "n", 0.9), ("a", "e", "m", "n", 0.1)], "a string, b string, a_content string, b_content string, near double")
    assert {r.b: r.kind for r in providers.link(pairs).collect()} == {"b": "supersedes", "c": "exception_to", "d": "read_with"}
    registry = providers.Registry()
    registry.use("rank", providers.rank)
    with pytest.raises(KeyError):
        registry.use("odd", providers.rank)
    assert providers.register(spark) and spark.sql("SELECT cosine(hashed_vector('a b'), hashed_vector('b a')) AS c").first().c == pytest.approx(1)
