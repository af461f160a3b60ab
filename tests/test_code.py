"""Facts of source code and the graph made of them."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import impact
from ledgerloom.plans import code as code_plans
from ledgerloom.sources import code, tree

SAMPLES = [
    ("ts", "export function hello() { return 1; }"),
    ("mts", "export function hello() { return 1; }"),
    ("cts", "export function hello() { return 1; }"),
    ("tsx", "export function hello() { return <div />; }"),
    ("js", "export function hello() { return 1; }"),
    ("py", "def hello():\n    return 1\n"),
    ("java", "class Example { public int hello() { return 1; } }"),
    ("go", "package main\nfunc hello() int { return 1 }"),
    ("rs", "pub fn hello() -> i32 { 1 }"),
    ("cs", "class Example { public int hello() { return 1; } }"),
]


@pytest.mark.parametrize(("extension", "source"), SAMPLES)
def test_every_language_gives_its_definition(extension, source):
    assert "hello" in [f[2] for f in code.facts_of(f"example.{extension}", source) if f[1] == "def"]


def by_kind(rel, source, kind):
    return [f for f in code.facts_of(rel, source) if f[1] == kind]


def test_script_facts():
    source = "import d, { first as f, type X } from './service.mjs';\n// call(x) import y from 'z'\nexport function api() {\n  return first('call()');\n}\nconst g = async (a) => f(a);\napp.get('/x/:id', () => { api(); });\nexport * from './other';\n"
    assert [f[5] for f in by_kind("api.ts", source, "import")] == ["./service.mjs", "./other"]
    assert [(f[2], f[6]) for f in by_kind("api.ts", source, "named")] == [("d", "d"), ("f", "first")]
    assert [(f[2], f[3], f[4]) for f in by_kind("api.ts", source, "call")] == [("first", 4, 3), ("f", 6, 6), ("app.", 7, 0), ("api", 7, 0)]
    assert [(f[2], f[5], f[6], f[3]) for f in by_kind("api.ts", source, "route")] == [("GET", "/x/:id", "express-like", 7)]


def test_python_facts():
    source = "from .sub import x as y\nfrom . import z\nfrom ..up.mod import w\nimport os.path\n@app.get('/q')\nasync def r():\n    def inner():\n        return y()\n    return z.k()\nclass K:\n    def m(self):\n        return r()\n"
    assert [f[5] for f in by_kind("a.py", source, "import")] == ["./sub", "./z", "../up/mod", "os.path"]
    assert [(f[2], f[4]) for f in by_kind("a.py", source, "call") if f[2] != "app."] == [("y", 7), ("z.", 6), ("r", 11)]
    assert [(f[2], f[5]) for f in by_kind("a.py", source, "route")] == [("GET", "/q")]
    assert [f[2] for f in by_kind("a.py", source, "export")] == ["r", "inner", "K", "m"]
    assert [f[1:3] for f in code.facts_of("broken.py", "def (")] == [("engine", "lines")] and [f[1:3] for f in code.facts_of("none.ts", "")] == [("engine", "scanner")]


@pytest.mark.parametrize(("rel", "source", "want"), [("A.java", 'class A { @GetMapping("/a") int x() { return y(); } }', ("GET", "/a", "spring")), ("A.cs", 'class A { [HttpPost("b")] int X() { return Y(); } }', ("POST", "b", "aspnet")), ("a.ts", "class A { @Get('c') x() { return 1; } }", ("GET", "c", "nest"))])
def test_routes_of_frameworks(rel, source, want):
    assert [(f[2], f[5], f[6]) for f in by_kind(rel, source, "route")] == [want]


def graph_of(spark, files, aliases=None):
    df = spark.createDataFrame(files, "rel string, content string")
    found = code.facts(df).persist()
    imports = code.resolved_imports(found, df, aliases)
    calls = code.call_edges(found, imports)
    return {r.id: r for r in code.modules(df, found, imports, calls).collect()}, calls


def test_imports_and_calls_across_files(spark):
    files = [("service.mts", "export function first() { return 1; }"), ("api.ts", "import { first as one } from './service.mjs';\nexport function api() { return one(); }\nexport function twice() { return api() + twice(); }"), ("alone.ts", "import { gone } from './missing';\ngone();"), ("empty.ts", "")]
    modules, _ = graph_of(spark, files)
    assert modules["api.ts"].imports == ["service.mts"] and modules["api.ts"].exports == ["api", "twice"]
    assert {s.name: s.calls for s in modules["api.ts"].symbols} == {"api": ["service.mts::first"], "twice": ["api.ts::api"]}
    assert (modules["service.mts"].degree, modules["api.ts"].degree, modules["alone.ts"].imports, modules["empty.ts"].symbols) == (1, 1, [], [])
    renamed, _ = graph_of(spark, [("renamed.mts", files[0][1]), files[1]])
    assert renamed["api.ts"].imports == []


def test_aliases_and_packages(spark):
    files = [("src/lib/a.ts", "export const go = () => 1;"), ("src/app/b.ts", "import { go } from '@lib/a';\nexport function run() { return go(); }"), ("pkg/__init__.py", ""), ("pkg/deep/x.py", "from ...top import f\nfrom .. import y\ndef g():\n    return f()\n"), ("top.py", "def f():\n    return 1\n"), ("pkg/y.py", "")]
    modules, _ = graph_of(spark, files, {"@lib/": "src/lib/"})
    assert modules["src/app/b.ts"].imports == ["src/lib/a.ts"]
    assert modules["src/app/b.ts"].symbols[0].calls == ["src/lib/a.ts::go"]
    assert modules["pkg/deep/x.py"].imports == ["pkg/y.py", "top.py"]
    assert modules["pkg/deep/x.py"].symbols[0].calls == ["top.py::f"]


def test_targets_of_an_alias_are_tried_in_order(spark):
    files = [("src/new/a.ts", ""), ("src/old/a.ts", ""), ("src/old/b.ts", ""), ("gen/c.view.ts", ""), ("one.ts", ""), ("x.ts", "import '@/a'; import '@/b'; import '@/gone'; import '#c.tpl'; import 'only'; import 'onlyx'; import '@/deep/z';"), ("src/z.ts", "")]
    df = spark.createDataFrame(files, "rel string, content string")
    aliases = {"@/*": ["src/new/*", "src/old/*"], "#*.tpl": ["gen/*.view.ts"], "only": ["one.ts"], "@/deep/*": ["nowhere/*"]}
    got = {r.spec: r.target for r in code.resolved_imports(code.facts(df), df, aliases).collect()}
    assert got == {"@/a": "src/new/a.ts", "@/b": "src/old/b.ts", "#c.tpl": "gen/c.view.ts", "only": "one.ts"}


def test_listing_is_sorted(spark, tmp_path):
    for name in ("b.ts", "a.py", "x.min.js"):
        (tmp_path / name).write_text("x")
    assert [r.rel for r in tree.listing(spark, str(tmp_path)).collect()] == ["a.py", "b.ts"]


def facts(rel, source):
    """(kind, name, line, owner) of all but imports, (kind, name, spec, orig) of these."""
    rows = code.facts_of(rel, source)
    return sorted((f[1], f[2], f[3], f[4]) for f in rows if f[1] in ("def", "export", "call")), [(f[1], f[2], f[5], f[6]) for f in rows if f[1] in ("import", "named")]


#: File, source, its exports, definitions (name, line) and calls (name, line, line of the definition around), its imports.
CONSTRUCTS = {
    "export list": ("a.ts", "const K = 1;\nexport { K as L, M };\nexport { default as D } from './d';\nexport * as ns from './n';", [("export", "D"), ("export", "L"), ("export", "M")], ["./d", "./n"]),
    "getter and setter": ("a.ts", "class A {\n  get v() { return f(); }\n  set v(x) { g(x); }\n}", [("call", "f", 2, 2), ("call", "g", 3, 3), ("def", "v", 2), ("export", "A")], []),
    "class on one line": ("a.ts", "export class A { m(x: number): string { return h(x); } static async n() { await i(); } }", [("call", "h", 1, 1), ("call", "i", 1, 1), ("def", "m", 1), ("def", "n", 1), ("export", "A")], []),
    "declared without a body": ("a.ts", "interface I { m(): void; n(x: T): U }\nabstract class B { abstract q(): void; }\nfunction over(a: A): void;\nfunction over(a: B): void { z(); }", [("call", "z", 4, 4), ("def", "over", 4)], []),
    "arrows": ("a.tsx", "const a = (x) => b(x)\nconst c = async <T,>(y: T): Promise<T> => {\n  return d(y);\n}, e = function () { f(); };\nclass G { h = () => { i(); }; j = k(); }", [("call", "b", 1, 1), ("call", "d", 3, 2), ("call", "f", 4, 4), ("call", "i", 5, 5), ("call", "k", 5, 0), ("def", "a", 1), ("def", "c", 2), ("def", "e", 4), ("def", "h", 5), ("export", "G")], []),
    "objects with methods": ("a.js", "module.exports = { m() { x(); }, n: () => y(), get p() { return z(); } };\nsetup(() => w());", [("call", "setup", 2, 0), ("call", "w", 2, 0), ("call", "x", 1, 1), ("call", "y", 1, 0), ("call", "z", 1, 1), ("def", "m", 1), ("def", "p", 1)], []),
    "constructor": ("a.ts", "class A {\n  constructor(x) {\n    super(x);\n    init(this.y(), new Z(q()));\n  }\n}", [("call", "init", 4, 2), ("call", "q", 4, 2), ("export", "A")], []),
    "no code in strings, comments, patterns": ("a.ts", "const r = /f\\(`[/'\"]/.test(s) ? `a${g(`${h()}`)}b()` : 'i()'; // j()\n/* k() */ l(a / b / c(1));", [("call", "c", 2, 0), ("call", "g", 1, 0), ("call", "h", 1, 0), ("call", "l", 2, 0)], []),
    "types are no imports": ("a.ts", "import type { T } from './t';\nimport e, * as all from './e';\nimport { type U, v as w } from './v';\nconst x = require('./x');\nimport './side';", [], ["./t", ("T", "./t", "T"), "./e", ("e", "./e", "e"), ("all", "./e", "all"), "./v", ("w", "./v", "v"), "./x", "./side"]),
    "generic and optional calls": ("a.ts", "f<string>(x); a?.b(); this.c(); a.b.c(); new D(); new E.F();", [("call", "a.", 1, 0), ("call", "f", 1, 0)], []),
    "Go": ("a.go", 'package p\nimport (\n\t"fmt"\n\t"os"\n\tx "a/b"\n)\nimport "one"\ntype T struct{ n int }\ntype (\n\tU int\n\tv string\n)\ntype I interface { Do(x int) error }\nfunc (t *T) Get() int { return make(t.n) }\nfunc run[K any](a K) (int, error) {\n\tgo func() { fmt.Println(`func x(`) }()\n\treturn lower(a)\n}', [("call", "fmt.", 16, 15), ("call", "lower", 17, 15), ("call", "make", 14, 14), ("def", "Get", 14), ("def", "run", 15), ("export", "Get"), ("export", "I"), ("export", "T"), ("export", "U")], ["fmt", ("fmt", "fmt", "fmt"), "os", ("os", "os", "os"), "a/b", ("b", "a/b", "b"), "one", ("one", "one", "one")]),
    "Rust": ("a.rs", "use crate::db::pool;\npub use std::io::{self, Read};\nuse one;\n#[derive(Debug)]\npub struct S<'a>(&'a str);\nenum E { A(u8), B }\npub trait T { fn need(&self); fn has(&self) { go() } }\nimpl S<'_> {\n    pub(crate) async fn new(x: u8) -> Self {\n        println!(\"{}\", hidden());\n        if let Some(y) = find::<u8>(x) { self.call(y.z()); }\n        Self::make('(')\n    }\n}\nfn free() {}", [("call", "call", 11, 9), ("call", "find", 11, 9), ("call", "go", 7, 7), ("call", "make", 12, 9), ("call", "z", 11, 9), ("def", "free", 15), ("def", "has", 7), ("def", "new", 9), ("export", "E"), ("export", "S"), ("export", "T"), ("export", "new")], ["src/db", ("pool", "src/db", "pool"), "std/io"]),
    "Java": ("A.java", 'package p;\nimport java.util.List;\nimport static a.B.c;\nimport x.y.*;\npublic class A<T> extends B {\n  private final int f = start(1);\n  public A(int x) { super(x); this.go(); }\n  @GetMapping("/a")\n  public <K> List<K> all(Map<K, T> m) throws E {\n    List.of(m); m.each(v -> use(v)); return new R(old()) { void in() { deep(); } };\n  }\n  abstract void none();\n  @RequestMapping\n  void any() {}\n}\nenum Z { Q }', [("call", "List.", 10, 8), ("call", "deep", 10, 10), ("call", "each", 10, 8), ("call", "go", 7, 7), ("call", "of", 10, 8), ("call", "old", 10, 8), ("call", "start", 6, 0), ("call", "use", 10, 8), ("def", "A", 7), ("def", "all", 8), ("def", "any", 13), ("def", "in", 10), ("def", "none", 12), ("export", "A"), ("export", "Z"), ("export", "all"), ("export", "any"), ("export", "in"), ("export", "none")], ["java.util.List", ("List", "java.util.List", "List"), "a.B.c", "x.y"]),
    "C#": ("A.cs", 'using System;\nusing A.B.C;\nusing X = Y.Z;\nnamespace N {\n  public class Cart : Base {\n    public Cart(int n) : base(n) { Fill(n); }\n    [HttpGet("items")]\n    public async Task<int> Get(int id) { using (var s = Open()) { return await Repo.Find(id); } }\n    public int Sum() => Add(1, 2);\n    public int P { get; set; } = Start();\n    [Route]\n    public void Any() { var c = new Cart(3); }\n  }\n  record R(int Q);\n}', [("call", "Add", 9, 9), ("call", "Fill", 6, 6), ("call", "Find", 8, 7), ("call", "Open", 8, 7), ("call", "Repo.", 8, 7), ("call", "Start", 10, 0), ("def", "Any", 11), ("def", "Cart", 6), ("def", "Get", 7), ("def", "Sum", 9), ("export", "Any"), ("export", "Cart"), ("export", "Get"), ("export", "R"), ("export", "Sum")], ["System", "A.B.C", "Y.Z"]),
}


@pytest.mark.parametrize("construct", CONSTRUCTS)
def test_constructs(construct):
    rel, source, want, imports = CONSTRUCTS[construct]
    found, brought = facts(rel, source)
    assert sorted({f if f[0] == "call" else f[:3] if f[0] == "def" else f[:2] for f in found}) == want
    assert [spec if kind == "import" else (name, spec, orig) for kind, name, spec, orig in brought] == imports


def test_routes_of_methods():
    java, cs = CONSTRUCTS["Java"], CONSTRUCTS["C#"]
    assert [(f[2], f[5], f[3]) for f in by_kind(*java[:2], "route")] == [("GET", "/a", 8), ("*", "", 13)]
    assert [(f[2], f[5], f[3]) for f in by_kind(*cs[:2], "route")] == [("GET", "items", 7), ("*", "", 11)]
    source = "router.all(`/x/${y}`, h);\napi.get(path);\nclass A {\n  @Post()\n  @Header('x')\n  b() {}\n}\nmy.app.get('/no');\nfastify.head('/y')"
    assert [(f[2], f[5], f[6], f[3]) for f in by_kind("a.ts", source, "route")] == [("ALL", "/x/${y}", "express-like", 1), ("POST", "", "nest", 4), ("HEAD", "/y", "express-like", 9)]


def test_python_that_does_not_parse():
    source = "from ..up import (a as b,\n   c)\nimport os, sys.path as p\nfrom . import d\n@app.route('/r')\ndef f(x):\n    '''g(1)'''\n    long(x)  # none(x)\n    def inner():\n        Deep.run()\n    return most(\nclass K:\n    def m(self): other(1)\ndef f(): pass\nlast_one()\nprint 'old'"
    rows = code.facts_of("a.py", source)
    assert rows[0][1:3] == ("engine", "lines")
    assert [(f[1], f[2], f[5], f[6]) for f in rows if f[1] in ("import", "named")] == [("import", None, "../up", None), ("named", "b", "../up", "a"), ("import", None, "../up", None), ("named", "c", "../up", "c"), ("import", None, "os", None), ("import", None, "sys.path", None), ("import", None, "./d", None), ("named", "d", "./d", "d")]
    assert [(f[2], f[3]) for f in rows if f[1] == "def"] == [("f", 6), ("inner", 9), ("m", 13)] and [f[2] for f in rows if f[1] == "export"] == ["f", "inner", "K", "m", "f"]
    assert [(f[2], f[3], f[4]) for f in rows if f[1] == "call"] == [("long", 8, 6), ("Deep.", 10, 9), ("most", 11, 6), ("other", 13, 13), ("last_one", 15, 0)]
    assert [(f[2], f[5]) for f in rows if f[1] == "route"] == [("*", "/r")]


def test_decorators_stand_outside():
    assert [(f[2], f[4]) for f in by_kind("a.py", "def f():\n    @dec(go())\n    def g():\n        return h()\n", "call")] == [("dec", 1), ("go", 1), ("h", 3)]


def test_engines_and_routes_by_place(spark):
    files = [("a.ts", "x();"), ("b.py", "x()"), ("c.py", "x( ="), ("pages/shop/[id].tsx", ""), ("d.go", None)]
    found = code.facts(spark.createDataFrame(files, "rel string, content string"))
    assert {tuple(r) for r in code.engines(found).collect()} == {("scanner", 3), ("parser", 1), ("lines", 1)}
    assert [tuple(r) for r in code.routes(found).collect()] == [("*", "/shop/:id", "pages/shop/[id].tsx", 1, "next")]


@pytest.mark.parametrize("extension", ["ts", "java", "go", "rs", "cs", "py"])
def test_any_text_gives_facts_or_none(extension):
    import random

    r = random.Random(4)
    marks = ["{", "}", "(", ")", "[", "]", "`", "${", "'", '"', "/", "//", "/*", "=>", "=", ";", ",", ".", "<", ">", "class ", "function ", "const ", "x", "\n", "export ", "import ", "func ", "fn ", "use ", "using ", ":", "@", "#", "!", "case "]
    for _ in range(1500):
        code.facts_of(f"a.{extension}", "".join(r.choices(marks, k=r.randint(0, 40))))


def test_large_files_take_time_in_proportion():
    assert [f[1] for f in code.facts_of("a.ts", "{(" * 20_000)] == ["engine"]
    assert sum(f[1] == "call" for f in code.facts_of("a.ts", "function f() { g(); }\n" * 20_000)) == 20_000
    assert sum(f[1] == "def" for f in code.facts_of("A.java", "class A {" + "".join(f" void m{i}() {{ n(); }}\n" for i in range(5000)) + "}")) == 5000


def test_one_piece_of_a_table_is_read_by_many_tasks(spark):
    """A table of one small piece makes files for as many tasks as shuffles have; facts are worked out once for a query."""
    part = spark.range(1, 41).select(F.col("id").alias("p_partkey")).coalesce(1)
    assert code_plans.files(part).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for query in (code_plans.code_modules, code_plans.code_routes):
        assert "MapInArrow" not in query(part)._jdf.queryExecution().toString()


def test_routes_are_cut_before_they_are_dealt(spark):
    rows = spark.range(0, 500).select(F.lit("GET").alias("method"), F.format_string("/%04d", "id").alias("path"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.when(F.col("id") % 5 > 0, "a").alias("framework"))
    found = impact.routes_by_framework(rows, 3)
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    assert sorted((r.framework or "", r.path, r.more) for r in found.collect()) == [("", "/0000", 97), ("", "/0005", 97), ("", "/0010", 97), ("a", "/0001", 397), ("a", "/0002", 397), ("a", "/0003", 397)]


def test_all_calls_of_python_that_does_not_parse():
    """However many calls a file makes, plain and through a name, each is a fact, the last one as the first."""
    source = "".join(f"def f{i}():\n    plain{i}()\n    Through{i}.run()\n" for i in range(1500)) + "print 'old'\n"
    rows = code.facts_of("a.py", source)
    assert rows[0][1:3] == ("engine", "lines")
    calls = [f for f in rows if f[1] == "call"]
    assert [(f[2], f[3], f[4]) for f in calls] == [x for i in range(1500) for x in ((f"plain{i}", 3 * i + 2, 3 * i + 1), (f"Through{i}.", 3 * i + 3, 3 * i + 1))]


def test_types_in_generics_of_any_length():
    """A call's types may be many tokens long; < and > of comparisons in different brackets make no types, and many < are paired once."""
    types = ", ".join(f"T{i}" for i in range(200))
    assert [f[2:5] for f in by_kind("a.ts", f"function f() {{ return make<{types}>(1); }}", "call")] == [("make", 1, 1)]
    assert [f[2] for f in by_kind("A.java", f"class A {{ <{types}> void m() {{ n(); }} }}", "def")] == ["m"]
    assert [f[2] for f in by_kind("a.ts", "if (i < n) { go() }\nif (j > (m)) { on() }", "call")] == ["go", "on"]
    assert [f[1] for f in code.facts_of("a.ts", "a < " * 40_000)] == ["engine"]


def test_modules_keep_all_exports(spark):
    """Exports by line, then name, each once, however many."""
    source = "".join(f"export function f{i}() {{}}\n" for i in range(100)) + "export { z, a, f3 };\n"
    modules, _ = graph_of(spark, [("a.ts", source), ("b.ts", "import { f99 } from './a';\nexport function go() { return f99(); }")])
    assert modules["a.ts"].exports == [*(f"f{i}" for i in range(100)), "a", "z"]
    assert modules["b.ts"].symbols[0].calls == ["a.ts::f99"]
