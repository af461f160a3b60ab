"""Queries on source files, which are written here from the rows of `part`: a file for each part, in one of four languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import impact
from ..sources import code
from ..sources.store import written
from ..workload import query

#: What a file of each kind says; # is the part's key, ~ the key four further on.
FILES = [
    ("src/p#.ts", "import { make~ as other } from './p~';\nexport class Part# {\n  get size() { return other(`#${lower(1)}`); }\n}\nexport { Part# as P# };\nexport function make#(n) {\n  return lower(n); // make#()\n}\nfunction lower(n) { return n; }\n"),
    ("src/p#.go", 'package p\n\nimport (\n\t"fmt"\n\tx "os"\n)\n\ntype Size# struct{ n int }\n\nfunc (s *Size#) Show() int {\n\tgo func() { fmt.Println(name(`func x(`)) }()\n\treturn len(s.n)\n}\n'),
    ("src/p#.py", "from .p~ import (total~ as total,\n    other)\n\ndef size#(a):\n    '''none(1)'''\n    def inner():\n        return total(a)\n    return total(a\n"),
    ("src/P#.java", 'import java.util.List;\n\npublic class P# {\n  @GetMapping("/part/#")\n  public List<P#> all(int x) {\n    return List.of(this.one(x));\n  }\n  P#() { super(); }\n}\n'),
]
#: Their facts: kind of file, then as the operator gives them.
FACTS = [
    *((0, "engine", "scanner", 0, None, None, None), (0, "import", None, 1, None, "./p~", None), (0, "named", "other", 1, None, "./p~", "make~"), (0, "export", "Part#", 2, None, None, None), (0, "def", "size", 3, None, None, None)),
    *((0, "export", "P#", 5, None, None, None), (0, "export", "make#", 6, None, None, None), (0, "def", "make#", 6, None, None, None), (0, "def", "lower", 9, None, None, None), (0, "call", "other", 3, 3, None, None), (0, "call", "lower", 3, 3, None, None), (0, "call", "lower", 7, 6, None, None)),
    *((1, "engine", "scanner", 0, None, None, None), (1, "import", None, 4, None, "fmt", None), (1, "named", "fmt", 4, None, "fmt", "fmt"), (1, "import", None, 5, None, "os", None), (1, "named", "os", 5, None, "os", "os"), (1, "export", "Size#", 8, None, None, None)),
    *((1, "def", "Show", 10, None, None, None), (1, "export", "Show", 10, None, None, None), (1, "call", "fmt.", 11, 10, None, None), (1, "call", "name", 11, 10, None, None), (1, "call", "len", 12, 10, None, None)),
    *((2, "engine", "lines", 0, None, None, None), (2, "import", None, 1, None, "./p~", None), (2, "named", "total", 1, None, "./p~", "total~"), (2, "import", None, 1, None, "./p~", None), (2, "named", "other", 1, None, "./p~", "other")),
    *((2, "def", "size#", 4, None, None, None), (2, "export", "size#", 4, None, None, None), (2, "def", "inner", 6, None, None, None), (2, "export", "inner", 6, None, None, None), (2, "call", "total", 7, 6, None, None), (2, "call", "total", 8, 4, None, None)),
    *((3, "engine", "scanner", 0, None, None, None), (3, "import", None, 1, None, "java.util.List", None), (3, "named", "List", 1, None, "java.util.List", "List"), (3, "export", "P#", 3, None, None, None), (3, "def", "all", 4, None, None, None), (3, "export", "all", 4, None, None, None)),
    *((3, "route", "GET", 4, None, "/part/#", "spring"), (3, "call", "List.", 6, 4, None, None), (3, "call", "of", 6, 4, None, None), (3, "call", "one", 6, 4, None, None), (3, "def", "P#", 8, None, None, None)),
]


def files(part: DataFrame) -> DataFrame:
    """rel, content of the files. Keys are dealt anew, as a table that is one small piece on disk makes many files to read."""
    part = part.select("p_partkey").repartition(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    put = lambda c: F.replace(F.replace(c, F.lit("#"), F.col("p_partkey").cast("string")), F.lit("~"), (F.col("p_partkey") + 4).cast("string"))
    kind = (F.col("p_partkey") % 4).cast("int") + 1
    one = lambda i: F.element_at(F.array(*(F.lit(f[i]) for f in FILES)), kind)
    return part.select(put(one(0)).alias("rel"), put(one(1)).alias("content"))


def _quoted(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


_PUT = "replace(replace({0}, '#', CAST(p_partkey AS VARCHAR)), '~', CAST(p_partkey + 4 AS VARCHAR))"
_RELS = ", ".join(f"({i}, {_quoted(rel)})" for i, (rel, _) in enumerate(FILES))
_FACTS = ", ".join("(" + ", ".join(map(_quoted, f)) + ")" for f in FACTS)


@query("part", sql=f"WITH r(f, rel) AS (VALUES {_RELS}), t(f, kind, name, line, owner, spec, orig) AS (VALUES {_FACTS}) SELECT {_PUT.format('rel')} AS rel, kind, {_PUT.format('name')} AS name, CAST(line AS INT) AS line, CAST(owner AS INT) AS owner, {_PUT.format('spec')} AS spec, {_PUT.format('orig')} AS orig FROM part JOIN r ON r.f = p_partkey % 4 JOIN t ON t.f = r.f")
def code_facts(part: DataFrame) -> DataFrame:
    """Imports, exports, definitions, calls with the definition around them, routes, and what read each file."""
    return code.facts(files(part))


@query("part", sql="SELECT CASE p_partkey % 4 WHEN 2 THEN 'lines' ELSE 'scanner' END AS engine, count(*) AS files FROM part GROUP BY 1")
def code_engines(part: DataFrame) -> DataFrame:
    return code.engines(code.facts(files(part)))


_SYMBOLS = "(0, 'size', 3), (0, 'make#', 6), (0, 'lower', 9), (1, 'Show', 10), (2, 'size#', 4), (2, 'inner', 6), (3, 'all', 4), (3, 'P#', 8)"


@query("part", sql=f"WITH r(f, rel) AS (VALUES {_RELS}), s(f, name, line) AS (VALUES {_SYMBOLS}), e(f, exports, loc) AS (VALUES (0, 'Part# P# make#', 10), (1, 'Size# Show', 14), (2, 'size# inner', 9), (3, 'P# all', 10)), p AS (SELECT p_partkey, p_partkey % 4 AS f, p_partkey % 4 IN (0, 2) AND p_partkey + 4 IN (SELECT p_partkey FROM part) AS goes, p_partkey % 4 IN (0, 2) AND p_partkey - 4 IN (SELECT p_partkey FROM part) AS comes FROM part) SELECT {_PUT.format('r.rel')} AS id, {_PUT.format('exports')} AS exports, CASE WHEN goes THEN {_PUT.format('replace(r.rel, chr(35), chr(126))')} ELSE '' END AS imports, CAST(loc AS INT) AS loc, CAST(goes AS BIGINT) + CAST(comes AS BIGINT) AS degree, {_PUT.format('name')} AS symbol, CAST(line AS INT) AS line, array_to_string(list_sort(CASE WHEN p.f = 0 AND name = 'size' AND goes THEN [{_PUT.format(repr('src/p#.ts::lower'))}, {_PUT.format(repr('src/p~.ts::make~'))}] WHEN p.f = 0 AND name <> 'lower' THEN [{_PUT.format(repr('src/p#.ts::lower'))}] ELSE [] END), ' ') AS calls FROM p JOIN r ON r.f = p.f JOIN s ON s.f = p.f JOIN e ON e.f = p.f")
def code_modules(part: DataFrame) -> DataFrame:
    """The index: exports, imports that lead to a file, size, degree, and each symbol with what it calls."""
    rows = _index(files(part))[0].withColumn("s", F.explode("symbols"))
    line = lambda c: F.array_join(c, " ")
    return rows.select("id", line("exports").alias("exports"), line("imports").alias("imports"), "loc", "degree", F.col("s.name").alias("symbol"), F.col("s.line").alias("line"), line(F.array_sort("s.calls")).alias("calls"))


def _index(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules and routes of files."""
    found = written(code.facts(sources), "facts")
    imports = code.resolved_imports(found, sources)
    return written(code.modules(sources, found, imports, code.call_edges(found, imports)), "modules"), code.routes(found)


#: The part whose file changes. Each file is imported by the one four keys before it.
CHANGED = 40


@query("part", sql=f"SELECT CAST(d AS INT) AS depth, 'src/p' || p_partkey || '.ts' AS file FROM part, range(1, 5) t(d) WHERE p_partkey = {CHANGED} - 4 * d AND {CHANGED} IN (SELECT p_partkey FROM part)")
def code_impact_files(part: DataFrame) -> DataFrame:
    """Files that a change of one file reaches in four steps."""
    modules, routes = _index(files(part))
    return impact.impact(modules, routes, *impact.resolve_target(modules, f"p{CHANGED}.ts"))["files"].select("depth", "file")


@query("part", sql=f"SELECT 'src/p' || p_partkey || '.ts::' || replace(name, '#', CAST(p_partkey AS VARCHAR)) AS symbol, CAST(depth AS INT) AS depth, 'src/p{CHANGED}.ts::' || via AS via FROM part JOIN (VALUES (0, 'make#', 1, 'lower'), (0, 'size', 1, 'lower'), (4, 'size', 2, 'make{CHANGED}')) v(step, name, depth, via) ON p_partkey = {CHANGED} - step")
def code_impact_symbols(part: DataFrame) -> DataFrame:
    """Symbols that call one, or call what calls it."""
    modules, routes = _index(files(part))
    return impact.impact(modules, routes, *impact.resolve_target(modules, f"p{CHANGED}.ts::lower"))["symbols"].select("symbol", "depth", "via")


@query("part", sql="SELECT 'spring' AS framework, 'GET' AS method, '/part/' || p_partkey AS path, 'src/P' || p_partkey || '.java' AS file, CAST(4 AS INT) AS line, greatest(count(*) OVER () - 80, 0) AS more FROM part WHERE p_partkey % 4 = 3 QUALIFY row_number() OVER (ORDER BY path, method, file) <= 80")
def code_routes(part: DataFrame) -> DataFrame:
    """Routes by framework, the first 80 of each and how many more there are."""
    return impact.routes_by_framework(code.routes(written(code.facts(files(part)), "facts")))


@query(
    "part",
    sql="WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS f, p_size % 10 AS s, p_partkey % 4 IN (0, 2) AND p_partkey + 4 IN (SELECT p_partkey FROM part WHERE p_size % 10 <> 0) AS stays, p_partkey % 4 IN (0, 2) AND p_partkey + 4 IN (SELECT p_partkey FROM part) AS had FROM part), n AS (SELECT *, CAST(had AS INT) AS i, CAST(stays AS INT) AS j, "
    "CASE f WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 4 END AS own, CASE f WHEN 0 THEN 10 WHEN 1 THEN 14 WHEN 2 THEN 9 ELSE 10 END AS loc, CASE WHEN s = 1 AND f = 0 THEN 2 ELSE 0 END AS more FROM p), "
    "r AS (SELECT *, least((own + j) / (own + i + more), loc / (loc + more / 2)) AS \"like\" FROM n) "
    "SELECT ['src/p', 'src/p', 'src/p', 'src/P'][f + 1] || k || ['.ts', '.go', '.py', '.java'][f + 1] AS key, CASE WHEN s = 0 THEN 'missing' WHEN \"like\" = 1 THEN 'unchanged' ELSE 'changed' END AS state, round(CASE WHEN s = 0 THEN 0 ELSE \"like\" END, 6) AS similarity FROM r",
)
def code_drift(part: DataFrame) -> DataFrame:
    """Each file before and after a change: some are gone, and with them imports of others; some scripts have a function more."""
    size = part.select("p_partkey", (F.col("p_size") % 10).alias("s"))
    before = files(part)
    keyed = before.withColumn("p_partkey", F.regexp_extract("rel", r"(\d+)", 1).cast("long")).join(size, "p_partkey").filter("s <> 0")
    extra = F.when((F.col("s") == 1) & F.endswith("rel", F.lit(".ts")), F.concat("content", F.lit("export function extra() {}\n"))).otherwise(F.col("content"))
    after = keyed.select("rel", extra.alias("content"))
    then, now = (impact.shapes(_index(x)[0]) for x in (before, after))
    rows = impact.drift(then.withColumn("key", F.col("file")), now, after.select(F.col("rel").alias("file")))
    return rows.select("key", "state", F.round("similarity", 6).alias("similarity"))
