"""Captures: one file a key, batches of bounded size, nothing lost or twice over stops."""

import threading

import pytest

from ledgerloom.sources import captures


def event(i, session="s"):
    return {"id": f"e{i}", "session": session, "at": "2024-05-01T10:00:00+00:00", "kind": "other", "role": "user", "content": f"text {i}"}


def rows(spark, to):
    return spark.read.parquet(to)


def drain(spark, tmp, flush):
    q = captures.ingested(spark, f"{tmp}/journal", f"{tmp}/table", f"{tmp}/state", flush)
    try:
        for _ in range(2):
            q.processAllAvailable()
    finally:
        q.stop()


def test_two_writers_of_one_key_leave_one_file(tmp_path):
    won, start = [], threading.Barrier(8)

    def write(k):
        start.wait()
        won.append(captures.capture(str(tmp_path), event(1) | {"content": str(k)}))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True] and len(list((tmp_path / "inbox").iterdir())) == 1
    assert captures.capture(str(tmp_path), event(1, "other session"))


def test_a_stopped_stream_goes_on_without_loss_or_repeats(spark, tmp_path):
    for i in range(23):
        captures.capture(f"{tmp_path}/journal", event(i))
    drain(spark, tmp_path, 5)
    sizes = [r["count"] for r in rows(spark, f"{tmp_path}/table").groupBy("batch").count().collect()]
    assert sum(sizes) == 23 and max(sizes) == 5
    for i in range(20, 40):  # three of them are known
        captures.capture(f"{tmp_path}/journal", event(i))
    drain(spark, tmp_path, 7)
    got = rows(spark, f"{tmp_path}/table")
    assert sorted(r.id for r in got.collect()) == sorted(f"e{i}" for i in range(40))
    assert max(r["count"] for r in got.groupBy("batch").count().collect()) == 7
    assert got.filter("id = 'e3'").first().content == "text 3"


def test_a_batch_that_failed_reads_the_same_files_again(spark, tmp_path):
    for i in range(6):
        captures.capture(f"{tmp_path}/journal", event(i))
    seen = []

    def fails(batch, number):
        seen.append((number, sorted(r.id for r in batch.collect())))
        if len(seen) == 1:
            raise RuntimeError("stopped here")

    for _ in range(2):
        q = captures.captures(spark, f"{tmp_path}/journal", 4).writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(fails).start()
        if not seen:
            with pytest.raises(Exception, match="stopped here"):
                q.processAllAvailable()
        else:
            q.processAllAvailable()
        captures.capture(f"{tmp_path}/journal", event(100 + len(seen)))  # published in between, of any name
    q.processAllAvailable()
    q.stop()
    assert seen[0] == seen[1] and len(seen[0][1]) == 4
    ids = [x for _, batch in seen[1:] for x in batch]
    assert len(ids) == len(set(ids)) and {f"e{i}" for i in range(6)} | {"e101"} <= set(ids)


def test_an_empty_folder_gives_no_batch(spark, tmp_path):
    drain(spark, tmp_path, 5)
    assert rows(spark, f"{tmp_path}/table").count() == 0
