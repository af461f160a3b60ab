"""Sources on small trees and journals made here."""

import json

import pytest

from ledgerloom.sources import journal, tree

HELLO = {"ts": "export function hello() {}", "mts": "export const hello = () => 1", "tsx": "export function hello() { return null }", "js": "function hello() {}", "py": "def hello():\n    pass", "java": "class A {\n  public void hello() {\n    if (x) {\n    }\n  }\n}", "go": "func hello() {}", "rs": "pub fn hello() {}", "cs": "class A {\n  public int hello(int a) {\n  }\n}"}


@pytest.fixture
def repo(tmp_path):
    for ext, source in HELLO.items():
        (tmp_path / f"src/a{ext}").mkdir(parents=True)
        (tmp_path / f"src/a{ext}/f.{ext}").write_text(source)
    for rel in ("node_modules/x.js", "src/.hidden/y.ts", "src/z.test.ts", "src/z.d.ts", "setup.py", "notes.txt", "gen/made.ts", "one.ts"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("const skipped = 1")
    return tmp_path


def test_scan_and_definitions(spark, repo):
    ignored = spark.createDataFrame([("gen/",), ("one.ts",)], "path string")
    files = tree.scan(spark, str(repo), ignored)
    assert {r.rel for r in files.collect()} == {f"src/a{e}/f.{e}" for e in HELLO}
    assert {r.rel for r in tree.scan(spark, str(repo)).collect()} >= {"gen/made.ts", "one.ts"}
    found = {(r.rel, r.name): r.line for r in tree.definitions(files).collect()}
    assert all((f"src/a{e}/f.{e}", "hello") in found for e in HELLO)
    assert found["src/ajava/f.java", "hello"] == 2 and ("src/ajava/f.java", "if") not in found


def test_imports(spark):
    texts = [("src/a.ts", 'import { b } from "./b.js"\nimport x from "../lib"\nconst y = require("./none")\nimport z from "pkg"'), ("src/b.ts", ""), ("lib/index.ts", ""), ("p/q/m.py", "from . import k\nfrom ..r import s\nimport os"), ("p/r.py", ""), ("p/q/__init__.py", "")]
    files = spark.createDataFrame(texts, "rel string, content string")
    specs = tree.imports(files)
    assert {r.spec for r in specs.collect()} == {"./b.js", "../lib", "./none", "pkg", ".", "..r", "os"}
    got = {(r.rel, r.spec): r.target for r in tree.resolved(specs, files).collect()}
    assert got == {("src/a.ts", "./b.js"): "src/b.ts", ("src/a.ts", "../lib"): "lib/index.ts", ("p/q/m.py", "."): "p/q/__init__.py", ("p/q/m.py", "..r"): "p/r.py"}


def test_journal(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text(json.dumps({"s": "a", "k": "inject", "tokens": 3}) + '\n{"s": "b", "k"\n' + json.dumps({"s": "c", "k": "tool", "tool": "edit"}) + "\n")
    rows = journal.read_journal(spark, [str(tmp_path / "j.jsonl")]).select("s", "k", "tokens", "tool").collect()
    assert sorted(map(tuple, rows)) == [("a", "inject", 3, None), ("c", "tool", None, "edit")]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "captures")
    for batch in ([("a", 1), ("a", 1), ("b", 2)], [("b", 2), ("c", 3)]):
        journal.write_once(spark.createDataFrame(batch, "id string, v long"), path, "id")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_word_vectors(spark, tmp_path):
    (tmp_path / "w.vec").write_text("3 2\nWord 3 4\nword 1 0\nzero 0 0\n")
    rows = journal.read_word_vectors(spark, str(tmp_path / "w.vec"), 2).collect()
    assert {r.word: r.vector for r in rows} == {"word": [76, 102], "zero": [0, 0]}
