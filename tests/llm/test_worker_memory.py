"""What a worker still holds when an operator is done, and how much of a table it gets at once."""

import gc
import tracemalloc

import pyarrow as pa
import public_tokenizers

from ledgerloom.llm import bpe, common, decontaminate


def kept_by(work) -> int:
    tracemalloc.start()
    try:
        work()
        gc.collect()
        return tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()


def test_no_words_stay():
    text = " ".join(f"word{i}," for i in range(100_000))
    assert kept_by(lambda: common.hash_words(common.words_of(text))) < 1_000_000
    assert kept_by(lambda: decontaminate.plain_hashes(text)) < 1_000_000


def test_marks_alone_are_no_words():
    assert decontaminate.plain_hashes("-- a. ... .b !").tolist() == decontaminate.plain_hashes("A b").tolist()
    assert not len(decontaminate.plain_hashes(None)) and not len(decontaminate.plain_hashes(" . "))


def test_a_vocabulary_goes_with_its_operator():
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["some words"])], names=["doc_id", "text"])
    assert next(bpe._run(public_tokenizers.path("byte_bpe_50k.json"))(iter([batch]))).num_rows == 1
    assert bpe.codec.cache_info().currsize == 1
    common.hash_words([b"word"])
    assert bpe.codec.cache_info().currsize == 0


def test_tables_are_written_in_small_batches(spark):
    rows = spark.range(400).selectExpr("id", "repeat('x', 50000) AS text").coalesce(1)
    before = {k: spark.conf.get(k) for k in common.WRITING}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], names=["size", "n"])

    found = common.written(rows.mapInArrow(sizes, "size long, n long"), "sizes").collect()
    assert sum(r.n for r in found) == 400 and max(r.size for r in found) < 6_000_000
    assert {k: spark.conf.get(k) for k in common.WRITING} == before


def test_narrow_rows_share_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = common.written(spark.range(5000).groupBy("id").count(), "counts", narrow=True)
        assert table.count() == 5000 and len(table.inputFiles()) == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
