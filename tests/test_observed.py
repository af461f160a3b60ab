"""Uses of tools, alias configuration, neighbours, rotation."""

import json

from pyspark.sql import functions as F

from ledgerloom.sources import journal, observed


def test_uses_of_tools(spark):
    rows = [
        (1, "edit", {"file_path": "/r/src/a.ts"}, {}, False),
        (2, "edit", {"path": "src\\b.ts"}, {"exit_code": 1}, False),
        (3, "edit", {"path": "../x"}, {"is_error": True}, False),
        (4, "apply_patch", {"patch": "*** Update File: a.ts\n+x\n*** Move to: b/../c.ts\n*** Add File: a.ts"}, {}, False),
        (5, "shell", {"command": "npm test"}, {"exitCode": 0}, True),
        (6, "edit", {"path": "/home/u/.agent/projects/p/memory/n.md"}, None, False),
    ]
    uses = spark.createDataFrame([(i, t, json.dumps(a), json.dumps(b) if b is not None else None, f) for i, t, a, b, f in rows], "id int, tool string, input string, response string, failed boolean")
    got = {r.id: (r.targets, r.outside, r.command, r.exit_code, r.failed) for r in observed.observations(uses, "/r").collect()}
    assert got == {1: (["src/a.ts"], False, None, None, False), 2: (["src/b.ts"], False, None, 1, True), 3: ([], True, None, None, True), 4: (["a.ts", "c.ts"], False, None, None, False), 5: ([], False, "npm test", 0, True), 6: ([], False, None, None, False)}


def test_aliases_follow_what_a_configuration_extends():
    files = {"tsconfig.json": '{ // own\n "extends": ["./base", "./gone.json"], "compilerOptions": {"baseUrl": "src",}, }', "base.json": '{"extends": "./tsconfig.json", "compilerOptions": {"paths": {"@lib/*": ["lib/*"], "@one": ["one.ts"]}}}'}
    assert observed.aliases_of(files.get) == {"@lib/": "lib/", "@one": "one.ts"}
    files["tsconfig.json"] = '{"extends": "./base", "compilerOptions": {"baseUrl": "src", "paths": {"~/*": ["app/*"]}}}'
    assert observed.aliases_of(files.get) == {"~/": "src/app/"}
    assert observed.aliases_of({"tsconfig.json": "{ broken"}.get) == {}
    files["tsconfig.json"] = '{"compilerOptions": {"paths": {"@/*.x": ["a/*", "./b/*"]}}}'
    assert observed.alias_targets(files.get) == {"@/*.x": ["a/*", "b/*"]}


def test_neighbours_of_words(spark):
    vectors = spark.createDataFrame([("a", 0, [127, 0]), ("b", 1, [120, 40]), ("c", 2, [0, 127]), ("far", 30_000, [127, 0])], "word string, row int, vec array<tinyint>")
    got = observed.neighbours(spark.createDataFrame([("a",)], "word string"), vectors).first()
    assert [x.word for x in got.near] == ["b", "c"]


def test_a_journal_rotates_once_it_is_long(spark, tmp_path):
    path = f"{tmp_path}/j"
    journal.append_journal(spark.range(10).withColumn("k", F.lit("x")), path)
    assert not observed.rotate(spark, path, 10**6) and observed.rotate(spark, path, 10) and not observed.rotate(spark, path, 10)
    journal.append_journal(spark.range(3).withColumn("k", F.lit("x")), path)
    assert journal.read_journal(spark, [path + ".old", path], "id long, k string").count() == 13
