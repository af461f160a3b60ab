"""Places, impact and rules, on the small graph and the six rules of the fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import impact, navigation, selection

MODULE = "id string, imports array<string>, exports array<string>, symbols array<struct<name:string,line:int,calls:array<string>>>, loc int, degree long"


@pytest.fixture(scope="module")
def modules(spark):
    return spark.createDataFrame([("src/billing.ts", [], ["chargeCustomer"], [("chargeCustomer", 1, [])], 4, 1), ("src/api.ts", ["src/billing.ts"], ["invoice"], [("invoice", 2, ["src/billing.ts::chargeCustomer"])], 4, 1)], MODULE)


@pytest.fixture(scope="module")
def routes(spark):
    return spark.createDataFrame([("POST", "/billing/charge", "src/billing.ts", 3, "express")], "method string, path string, file string, line int, framework string")


@pytest.mark.parametrize(
    ("prompt", "want"),
    [
        ("fix rounding in chargeCustomer", [("definition", "chargeCustomer", "src/billing.ts", 1), ("caller", "invoice", "src/api.ts", 2)]),
        ("inspect src/billing.ts", [("module", None, "src/billing.ts", None), ("imported by", None, "src/api.ts", None)]),
        ("change what invoice returns", [("definition", "invoice", "src/api.ts", 2)]),
        ("write the release notes", []),
        ("", []),
    ],
)
def test_places_for_prompts(modules, routes, prompt, want):
    rows = navigation.navigate(modules, routes, prompt).orderBy("position").collect()
    assert [(r.kind, r.name, r.file, r.line) for r in rows] == want


def test_covering_takes_new_words_from_new_files():
    from pyspark.sql import Row

    best = [Row(score=9.0, file="a", hits=["x", "y"]), Row(score=8.0, file="a", hits=["z"]), Row(score=7.0, file="b", hits=["x"]), Row(score=6.0, file="c", hits=["z"]), Row(score=1.0, file="d", hits=["q"])]
    assert [r.file for r in navigation.covering(best)] == ["a", "c"]


def test_impact_of_a_file_and_of_a_symbol(modules, routes):
    got = impact.impact(modules, routes, "src/billing.ts", "file")
    assert [tuple(r) for r in got["summary"].collect()] == [(1, 1, False)]
    assert [tuple(r) for r in impact.layers(got["files"]).collect()] == [(1, ["src/api.ts"])]
    assert [tuple(r) for r in got["symbols"].collect()] == [("src/api.ts::invoice", 1, "src/billing.ts::chargeCustomer")]
    assert got["routes"].count() == 0
    by_symbol = impact.impact(modules, routes, "src/billing.ts::chargeCustomer", "symbol")
    assert [r.file for r in by_symbol["routes"].collect()] == ["src/billing.ts"] and by_symbol["summary"].first().transitive == 1


def test_targets(modules):
    want = {"src/api.ts": ("src/api.ts", "file"), "api.ts": ("src/api.ts", "file"), "invoice": ("src/api.ts::invoice", "symbol"), "api.ts::invoice": ("src/api.ts::invoice", "symbol"), ".ts": None, "none": None, "api.ts::none": None}
    assert {q: impact.resolve_target(modules, q) for q in want} == want


def test_a_budget_of_nodes_cuts_and_says_so(spark):
    from ledgerloom.operators import graph

    edges = spark.createDataFrame([("a", f"n{i:02}") for i in range(9)], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    rows = graph.reach_within(edges, start, 4, 5).collect()
    assert sorted(r.node for r in rows) == ["a", "n00", "n01", "n02", "n03"] and any(r.cut for r in rows)
    assert not any(r.cut for r in graph.reach_within(edges, start, 4, 10).collect())


def test_drift_and_report(spark, modules, routes):
    now = impact.shapes(modules)
    before = now.withColumn("key", F.lit("k")).unionByName(now.limit(1).select(F.lit("gone.ts").alias("file"), "shape", "loc", F.lit("m").alias("key")))
    changed = now.withColumn("key", F.lit("c")).withColumn("loc", F.col("loc") * 2)
    unknown = now.limit(1).select(F.lit("new.ts").alias("file"), "shape", "loc", F.lit("u").alias("key"))
    there = spark.createDataFrame([("src/api.ts",), ("src/billing.ts",), ("new.ts",)], "file string")
    got = {r.key: (r.state, r.similarity) for r in impact.drift(before.unionByName(changed).unionByName(unknown), now, there).collect()}
    assert got == {"k": ("unchanged", 1.0), "m": ("missing", 0.0), "c": ("changed", 0.5), "u": ("unknown", None)}
    assert "- **src**: 2 files, 8 lines" in impact.report(modules, routes) and "`POST   /billing/charge` in src/billing.ts:3" in impact.report(modules, routes)


def unit(*x):
    n = math.hypot(*x) or 1
    return [a / n for a in x]


CONTENTS = ["Logs go through the audit logger, never print.", "Archive exports are signed with the ledger key under epoch E7.", "Supersede epoch E7: use epoch E9 from now on.", "Retry the nightly job with an exponential delay.", "Keep the changelog in reverse order.", "Quarterly export files are written as CSV."]
VECTORS = [unit(0, 1, 0), unit(1, 0, 0.2), unit(0.1, 0, 1), unit(0, 0.6, 0.1), unit(0.2, 0.3, 0), unit(0.9, 0, 0)]
MESSAGE = "Add an archive export command for the auditors."
RULE = "idx int, content string, vector array<double>, depth int"


def rules_of(spark, vectors=VECTORS, depth=lambda i: 0):
    return spark.createDataFrame([(i, c, v, depth(i)) for i, (c, v) in enumerate(zip(CONTENTS, vectors, strict=True))], RULE)


def reader(scores, other=0.0):
    out = F.lit(float(other))
    for i, s in scores.items():
        out = F.when(F.col("idx") == i, F.lit(float(s))).otherwise(out)
    return lambda pool: pool.select("idx", out.alias("score"))


def order_of(df):
    return [r.idx for r in df.orderBy("position").collect()]


def test_every_rule_is_placed_once(spark):
    rules = rules_of(spark)
    order = order_of(selection.rank_rules(rules, MESSAGE, unit(1, 0, 0), reader({})))
    assert sorted(order) == list(range(6)) and order[0] == 1 and 2 in order[:4] and order.index(2) < order.index(0)
    scoped = order_of(selection.rank_rules(rules_of(spark, depth=lambda i: 6 * (i == 4)), MESSAGE, unit(1, 0, 0), reader({})))
    assert scoped.index(4) < order.index(4)
    links = spark.createDataFrame([(1, 4)], "a int, b int")
    assert order_of(selection.rank_rules(rules, MESSAGE, unit(1, 0, 0), reader({}), links)).index(4) < 4


def test_the_reader_moves_a_rule_and_words_place_one_without_vector(spark):
    rules, blind = rules_of(spark), [0.0, 0.0, 0.0]
    assert order_of(selection.rank_rules(rules, MESSAGE, blind, reader({3: 5}, -5))).index(3) < order_of(selection.rank_rules(rules, MESSAGE, blind, reader({}))).index(3)
    placed = order_of(selection.rank_rules(rules_of(spark, [v if i != 1 else None for i, v in enumerate(VECTORS)]), MESSAGE, unit(1, 0, 0), reader({})))
    assert placed.index(1) < placed.index(0) and placed.index(1) < placed.index(3)


@pytest.mark.parametrize(("scores", "links", "want"), [({1: 0.9}, None, [1, 2]), ({}, None, []), ({1: 0.9}, [(1, 4)], [1, 4]), ({1: 0.9}, [(1, 0), (1, 3), (1, 4)], [1, 0, 3]), ({0: 0.9, 1: 0.8, 5: 0.7}, [(5, 3), (0, 1)], [0, 1, 5])])
def test_rules_that_a_message_needs(spark, scores, links, want):
    links = spark.createDataFrame(links, "a int, b int") if links else None
    assert selection.select_rules(rules_of(spark), MESSAGE, unit(1, 0, 0), reader(scores, 0.1), 0.56, 0.45, links) == want


def test_a_crowd_leaves_few(spark):
    alike = spark.createDataFrame([(i, f"Help line of operator {i} ends with its band code, written by the archive export generator.", None, 0) for i in range(20)], RULE)
    high = lambda pool: pool.select("idx", (0.77 - F.col("idx") * 0.001).alias("score"))
    assert len(selection.select_rules(alike, MESSAGE, None, high, 0.56, 0.45)) <= 6
    half = lambda pool: pool.select("idx", F.when(F.col("idx") < 10, 0.8).otherwise(0.1).alias("score"))
    assert len(selection.select_rules(alike, MESSAGE, None, half, 0.56, 0.45)) >= 10


def test_insertion_equals_splicing(spark):
    import random

    r = random.Random(2)
    for _ in range(4):
        lexical = r.sample(range(9), 9)
        known = [i for i in r.sample(range(9), 9) if i % 3]
        want = list(known)
        for rank, i in enumerate(lexical):
            if i % 3 == 0:
                want.insert(min(rank, len(want)), i)
        order = spark.createDataFrame([(i, k) for k, i in enumerate(known)], "idx int, rank int")
        others = spark.createDataFrame([(i, k) for k, i in enumerate(lexical) if i % 3 == 0], "idx int, rank int")
        got = selection.inserted(order, others)
        assert [x.idx for x in got.orderBy("rank").collect()] == want
