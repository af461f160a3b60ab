"""Vectors of knowledge and of modules; pages of bounded length."""

import pytest

from ledgerloom.sources import knowledge, vectors


def heads(spark, *rows):
    return spark.createDataFrame(rows, "knowledge_id string, id string, state string, content string")


def test_int8_vectors_follow_versions_and_tables(spark, tmp_path):
    path = f"{tmp_path}/v"
    rows = lambda *x: spark.createDataFrame(x, "knowledge_id string, version_id string, vec array<tinyint>")
    now = heads(spark, ("a", "a1", "active", "x"), ("b", "b1", "active", "y"), ("c", "c1", "archived", "z"))
    assert {r.knowledge_id for r in vectors.without_vector(spark, path, "t1", now).collect()} == {"a", "b"}
    vectors.save_vectors(spark, path, "t1", rows(("a", "a1", [1, -127]), ("b", "b1", None), ("c", "c1", [3, 4])))
    got = lambda table, h: {r.knowledge_id: r.vec for r in vectors.stored_vectors(spark, path, table, h).collect()}
    assert got("t1", now) == {"a": [1, -127]} and vectors.without_vector(spark, path, "t1", now).count() == 0
    later = heads(spark, ("a", "a2", "active", "x2"), ("b", "b1", "active", "y"))
    assert got("t1", later) == {} and [r.version_id for r in vectors.without_vector(spark, path, "t1", later).collect()] == ["a2"]
    vectors.save_vectors(spark, path, "t2", rows(("a", "a2", [5, 6])))
    assert got("t2", later) == {"a": [5, 6]} and got("t1", later) == {} and vectors.without_vector(spark, path, "t2", later).count() == 1


def test_module_vectors_are_read_as_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 7)
    rows = [(f"src/m{i:02}.ts", [i / 2, -1.5]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, vec array<float>")
    assert vectors.save_module_vectors(df, f"{tmp_path}/m") == 2 and vectors.save_module_vectors(df, f"{tmp_path}/m") == 2
    assert sorted((r.id, r.vec) for r in vectors.load_module_vectors(spark, f"{tmp_path}/m").collect()) == rows
    assert spark.read.parquet(f"{tmp_path}/m").count() >= 6
    with pytest.raises(ValueError, match="one length"):
        vectors.save_module_vectors(df.unionByName(spark.createDataFrame([("x", [1.0])], "id string, vec array<float>")), f"{tmp_path}/n")


def test_a_page_that_is_too_long_is_refused(spark):
    page = spark.createDataFrame([(1, "{}", "https://h.org/t/r/x")] * (knowledge.PAGE + 1), "page int, record string, url string")
    with pytest.raises(ValueError, match="more than 30"):
        knowledge.new_page_records(page, spark.createDataFrame([], "id string"), "h.org/t/r")
    assert knowledge.new_page_records(page.limit(30), spark.createDataFrame([], "id string"), "h.org/t/r").count() == 1
