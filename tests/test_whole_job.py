"""Queries that look at the whole table where an older one of the same kind takes a part of it."""

import random
import re

import duckdb

from ledgerloom import workload
from ledgerloom.operators import graph
from ledgerloom.plans import graph as plan
from ledgerloom.plans import history

SF = "/root/testdata/sf0.001"


def test_all_suppliers_are_compared(spark, tmp_path):
    rows = [(100, 1), (100, 2), (200, 2), (200, 3), (3, 3), (3, 3), (400, 9)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.a, r.b): r.jaccard for r in workload.queries()["shape_jaccard_all"](spark, str(tmp_path)).collect()}
    assert got == {(100, 200): 0.333333, (3, 200): 0.5}


def test_every_document_is_inserted_once(spark):
    counts = workload.queries()["insert_or_ignore_all"](spark, SF).collect()
    assert sum(r.n for r in counts) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_relations_grow_with_the_orders(spark):
    orders = spark.range(1000).toDF("o_orderkey")
    ends = history.order_relations(orders)
    assert ends.select("src").distinct().count() == 1000
    assert ends.count() == 500 + 1000 - 1


SECRETS = {
    "a -----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- b": "a [REDACTED PRIVATE KEY] b",
    "a -----BEGIN PRIVATE KEY-----\nnever ended\n": "a [REDACTED PRIVATE KEY]",
    "sk-abcdefghijklmnop-- ghp_0123456789abcdef, xsk-abcdefghijklmnop sk-short": "[REDACTED TOKEN]-- [REDACTED TOKEN], xsk-abcdefghijklmnop sk-short",
    "\u00e9sk-abcdefghijklmnop\u00e9": "\u00e9[REDACTED TOKEN]\u00e9",
    "bEaReR\u00a0ab.c~d== Bearer": "Bearer [REDACTED] Bearer",
    '{"Password": "x y", api-key=\'q\', ACCESS_TOKEN : t}': '{"Password=[REDACTED] y", api-key=[REDACTED]\', ACCESS_TOKEN=[REDACTED]}',
    "Authorization: Bearer abc, passwords: kept, pa\u017f\u017fword=kept": "Authorization=[REDACTED] [REDACTED], passwords: kept, pa\u017f\u017fword=kept",
    "password=[REDACTED]": "password=[REDACTED]",
    "x" * 12_000: "x" * 12_000,
    "y" * 11_990 + " password=secret": "y" * 11_990 + " password=",
}


def test_secrets_go_from_both_tables(spark, tmp_path):
    texts = [*SECRETS, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in workload.queries()["redact_secrets"](spark, str(tmp_path)).collect()]
    for kind in ("document", "conversation"):
        by_id = {r[1]: r[3:] for r in got if r[0] == kind}
        for i, (text, want) in enumerate(SECRETS.items()):
            assert by_id[i] == (want, text.startswith("y"), text.startswith("y") or text != want)
        assert by_id[len(SECRETS)] == (None, None, None)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(workload.oracle_sql()["redact_secrets"]).fetchall()))


def test_pairs_of_suppliers_are_not_shuffled_one_by_one(spark, monkeypatch):
    """Long lists of makers in blocks, sums of one supplier over several batches, nulls; no row is shuffled for a pair that meets in a part."""
    monkeypatch.setattr(graph, "BLOCK", 3, raising=False)
    r = random.Random(5)
    rows = [(r.randrange(-3, 12), r.randrange(40)) for _ in range(250)] + [(None, 1), (4, None), (5, None), (5, None)]
    made = {}
    for k, p in rows:
        made.setdefault(k, set()).add(p)
    shared = {(a, b): made[a] & made[b] - {None} for a in made for b in made if None not in (a, b) and a < b}
    want = {(a, b): round(len(c) / (len(made[a]) + len(made[b]) - len(c)), 6) for (a, b), c in shared.items() if c}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = plan._jaccard(spark.createDataFrame(rows, "l_suppkey long, l_partkey long"))
        assert {(x.a, x.b): x.jaccard for x in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    dealt = [x for x in out._jdf.queryExecution().toString().splitlines() if "Exchange" in x]
    assert dealt and not any(re.search(r"\(a#\d+L?, b#", x) for x in dealt)
