"""Single stages of the pipeline."""

import numpy as np

import corpus_pipeline
from ledgerloom.llm import language_id


def test_copies_from_eighty_percent_on_go(spark):
    words = [f"w{i}" for i in range(104)]
    longer = [*words, *(f"x{i}" for i in range(22))]  # 100 of 122 shingles shared: 0.82
    other = [*words, *(f"y{i}" for i in range(30))]  # 100 of 130: 0.77, and less with the one before
    rows = [(i, " ".join(w)) for i, w in enumerate((words, longer, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [0, 2]


def test_documents_pass_if_no_language_can_be_learnt(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "123", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()) == [1, 2]


def test_the_score_decides(spark, monkeypatch):
    unsure = language_id.Network(["a", "b", "c", "d"])
    unsure.parameters[4][:] = 0
    sure = language_id.Network(["a", "b", "c", "d"])
    sure.parameters[4][:] = 0
    sure.parameters[5][:] = np.array([3, 0, 0, 0], np.float32)
    docs = spark.createDataFrame([(1, "some words", "a"), (2, "123", "a")], "doc_id long, text string, lang string")
    for network, want in ((unsure, []), (sure, [1])):
        monkeypatch.setattr(language_id, "train", lambda _, network=network: network)
        assert [r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()] == want
