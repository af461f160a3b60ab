"""Negative doc_ids are ids like others."""

from ledgerloom.llm import minhash_dedup


def test_copies_with_negative_ids_are_linked(spark):
    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(-5, " ".join(words)), (-1, " ".join([*words, "x"])), (-3, " ".join([*words, "y"]))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {-5: -5, -1: -5, -3: -5}
