"""Links of new rules and the way back; the bounded cache of neighbours; backups that are read twice."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import links
from ledgerloom.sources import commits, knowledge, neighbour_cache, observed


def version(i, content, at="2026-01-01T00:00:00Z", state="active", number=1):
    return (f"v{i}", f"k{i}", number, None, "constraint", state, content, [], [f"s{i}"], [], at, None, None)


def test_new_rules_are_linked_once_and_replaced_ones_come_back(spark):
    rows = [version(i, f"use tool{i} for step{i}") for i in range(30)] + [version(40, "Never push to main"), version(50, "never push to main.", "2026-03-01T00:00:00Z"), version(51, "use tool7 for step7 except at night", "2026-03-02T00:00:00Z")]
    versions = spark.createDataFrame(rows, knowledge.VERSIONS)
    relations = spark.createDataFrame([], knowledge.RELATIONS)
    vectors = spark.createDataFrame([("k3", [1.0, 0.0])], "knowledge_id string, vec array<float>")
    pairs = links.candidates(versions, vectors, "2026-02-01T00:00:00Z")
    assert {r.a for r in pairs.collect()} == {"v50", "v51"} and pairs.count() == 16
    new, over = links.linked(pairs, versions, relations, "2026-03-03T00:00:00Z")
    kinds = {(r["from"].id, r.to.id, r.kind) for r in new.collect()}
    assert ("v50", "v40", "supersedes") in kinds and ("v51", "v7", "exception_to") in kinds
    gone = over.collect()
    assert [(r.knowledge_id, r.version, r.state, r.previous_version_id) for r in gone] == [("k40", 2, "superseded", "v40")]
    versions, relations = versions.unionByName(over), relations.unionByName(new)
    again, none = links.linked(links.candidates(versions, vectors, "2026-02-01T00:00:00Z"), versions, relations, "2026-03-04T00:00:00Z")
    assert not [r for r in again.collect() if r.kind == "supersedes"] and none.count() == 0
    same, none = links.linked(pairs, versions, relations, "2026-03-04T00:00:00Z")
    assert same.count() == none.count() == 0
    assert [r.knowledge_id for r in links.replaced_rules(versions, relations).collect()] == ["k40"]
    with pytest.raises(ValueError, match="no replaced rule"):
        links.reactivated(versions, relations, "k7", "now")
    back = links.reactivated(versions, relations, "k40", "2026-03-05T00:00:00Z")
    assert [(r.version, r.state) for r in links.heads(versions.unionByName(back)).filter("knowledge_id = 'k40'").collect()] == [(3, "active")]
    assert links.replaced_rules(versions.unionByName(back), relations).count() == 0


def test_known_words_compute_nothing_and_the_oldest_goes(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/cache"
    vectors = spark.createDataFrame([(f"w{i}", i, [127 - i, i]) for i in range(6)], "word string, row int, vec array<tinyint>")
    ask = lambda *w: {r.word: [n.word for n in r.near] for r in neighbour_cache.neighbours(spark.createDataFrame([(x,) for x in w], "word string"), vectors, path, 3).collect()}
    first = ask("w0", "none")
    assert first["w0"][0] == "w1" and first["none"] == []
    done = commits.revision(spark, path)
    with monkeypatch.context() as m:
        m.setattr(observed, "neighbours", lambda *_: 1 / 0)
        assert ask("w0", "none") == first and commits.revision(spark, path) == done
    assert set(ask("w0", "w2", "w3")) == {"w0", "w2", "w3"}
    assert {r.word for r in neighbour_cache.kept(spark, path).collect()} == {"w0", "w2", "w3"}  # "none" was the first to enter


def test_a_backup_is_read_twice(spark, tmp_path, monkeypatch):
    root = tmp_path / "store"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.txt").write_text("hello")
    (root / "y.bin").write_bytes(b"\x00\x01")
    assert knowledge.backup(spark, str(root), f"{tmp_path}/b", "repo") == 2
    with pytest.raises(ValueError, match="outside"):
        knowledge.backup(spark, str(root), f"{root}/b")
    assert knowledge.restore(spark, f"{tmp_path}/b", f"{tmp_path}/new", "repo") == 2
    assert (tmp_path / "new" / "a" / "x.txt").read_text() == "hello" and (tmp_path / "new" / "y.bin").read_bytes() == b"\x00\x01"
    with pytest.raises(ValueError, match="there already"):
        knowledge.restore(spark, f"{tmp_path}/b", f"{tmp_path}/new", "repo")
    with pytest.raises(ValueError, match="is of repo"):
        knowledge.restore(spark, f"{tmp_path}/b", f"{tmp_path}/other", "moved")
    assert knowledge.restore(spark, f"{tmp_path}/b", f"{tmp_path}/other", "moved", relocate=True) == 2
    read, calls = knowledge._files, []

    def changing(spark, folder):
        calls.append(folder)
        if len(calls) == 3:  # after the copy
            (root / "a" / "x.txt").write_text("changed meanwhile")
        return read(spark, folder)

    monkeypatch.setattr(knowledge, "_files", changing)
    with pytest.raises(ValueError, match="changed during"):
        knowledge.backup(spark, str(root), f"{tmp_path}/c")
    assert not (tmp_path / "c").exists()
    spark.read.parquet(f"{tmp_path}/b").withColumn("content", F.lit(b"x")).write.parquet(f"{tmp_path}/broken")
    with pytest.raises(ValueError, match="does not agree"):
        knowledge.restore(spark, f"{tmp_path}/broken", f"{tmp_path}/z", "repo")
