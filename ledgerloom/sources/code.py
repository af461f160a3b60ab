"""Facts of source code: imports, exports, definitions, calls with the definition they stand in, routes; and the graph made of them.

Python is read by its own parser, and line by line if that refuses a file; languages with brackets by `scanner`. What read a file is
one of its facts; `engines` counts them."""

from __future__ import annotations

import ast
import keyword
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from . import scanner, tree

FACTS = "rel string, kind string, name string, line int, owner int, spec string, orig string"
# Most routes of a file, and the name of what stands outside of definitions.
ROUTES, TOP = 200, "(module)"
# Words before a bracket that the second tier takes for no calls.
NOT_PYTHON_CALLS = {"if", "for", "while", "return", "print", "len", "range", "str", "int", "dict", "list", "set", "tuple", "type", "isinstance", "super", "open", "enumerate"}
_PYTHON_VERBS = {"get", "post", "put", "patch", "delete"}

_QUOTED = re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|#[^\n]*", re.S)
_PYTHON = re.compile(r"^(?P<indent>[ \t]*)(?:(?:async[ \t]+)?def[ \t]+(?P<def>\w+)|class[ \t]+(?P<class>\w+)|from[ \t]+(?P<dots>\.*)(?P<module>[\w.]*)[ \t]+import\b(?P<names>[^\n(]*(?:\([^)]*\)?)?)|import[ \t]+(?P<import>[^\n]+))", re.M)
_CALL = re.compile(r"(?<![\w.])(?P<plain>[A-Za-z_]\w{2,})\s*\(|(?<![\w.])(?P<through>[A-Z]\w{2,})\.\w+\s*\(")
_PYTHON_ROUTE = re.compile(r"@\s*[\w.]+\.(get|post|put|patch|delete|route)\s*\(\s*[\"']([^\"']+)[\"']")


def _blanked(source: str) -> str:
    """Python with comments and strings replaced by blanks of the same length."""
    return _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _relative(dots: str, module: str) -> str:
    """The specification of a Python module: a path if it begins with dots."""
    return ("./" if len(dots) == 1 else "../" * (len(dots) - 1)) + module.replace(".", "/") if dots else module


def _by_lines(rel: str, source: str) -> Iterator[tuple]:
    """Python that its parser refuses, line by line: what a line begins with, and by its indentation whose line it is."""
    code, starts = _blanked(source), [0, *(m.end() for m in re.finditer("\n", source))]
    line = lambda place: bisect_right(starts, place)
    blocks, seen, taken = [], set(), set()  # (line, indentation, definition's line)
    for m in _PYTHON.finditer(code):
        at, wide = line(m.start()), len(m["indent"].expandtabs())
        if m["def"]:
            blocks.append((at, wide))
            taken.add(m.start("def"))
            if m["def"] not in seen:
                seen.add(m["def"])
                yield rel, "def", m["def"], at, None, None, None
        if m["def"] or m["class"]:
            taken.add(m.start("class"))
            yield rel, "export", m["def"] or m["class"], at, None, None, None
        elif m["import"]:
            for part in m["import"].split(","):
                if name := re.match(r"\s*([\w.]+)", part):
                    yield rel, "import", None, at, None, name[1], None
        elif m["dots"] or m["module"]:
            names = re.findall(r"(\w+)(?:\s+as\s+(\w+))?", m["names"])
            for name, alias in names:
                spec = _relative(m["dots"], m["module"] or name)
                yield rel, "import", None, at, None, spec, None
                yield rel, "named", alias or name, at, None, spec, name
    lines, owner, open_, k = code.split("\n"), [0], [], 0
    for n, text in enumerate(lines, 1):
        if text.strip():
            wide = len(text.expandtabs()) - len(text.expandtabs().lstrip())
            while open_ and open_[-1][1] >= wide:
                open_.pop()
            if k < len(blocks) and blocks[k][0] == n:
                open_.append(blocks[k])
                k += 1
        owner.append(open_[-1][0] if open_ else 0)
    for m in _CALL.finditer(code):
        name = m["plain"] or m["through"]
        if name in NOT_PYTHON_CALLS or keyword.iskeyword(name) or m.start() in taken:
            continue
        yield rel, "call", name + ("." if m["through"] else ""), line(m.start()), owner[line(m.start())], None, None
    for m in _PYTHON_ROUTE.finditer(source):
        if code[m.start()] == "@":
            yield rel, "route", "*" if m[1] == "route" else m[1].upper(), line(m.start()), None, m[2], "python"


def _by_parser(rel: str, parsed: ast.Module) -> Iterator[tuple]:
    def walk(node: ast.AST, owner: int) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, ast.Import):
                for a in child.names:
                    yield rel, "import", None, child.lineno, None, a.name, None
            elif isinstance(child, ast.ImportFrom):
                up = "" if not child.level else "./" if child.level == 1 else "../" * (child.level - 1)
                spec = up + (child.module or "").replace(".", "/") if up else child.module
                for a in child.names:
                    own = up + a.name if up and not child.module else spec  # from . import name
                    yield rel, "import", None, child.lineno, None, own, None
                    yield rel, "named", a.asname or a.name, child.lineno, None, own, a.name
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                yield rel, "def", child.name, child.lineno, None, None, None
                yield rel, "export", child.name, child.lineno, None, None, None
                for d in child.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in (*_PYTHON_VERBS, "route") and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                        yield rel, "route", "*" if d.func.attr == "route" else d.func.attr.upper(), d.lineno, None, d.args[0].value, "python"
                for d in child.decorator_list:  # they stand outside
                    yield from walk(ast.Expression(d), owner)
                child.decorator_list = []
                inner = child.lineno
            elif isinstance(child, ast.ClassDef):
                yield rel, "export", child.name, child.lineno, None, None, None
            elif isinstance(child, ast.Call):
                if isinstance(child.func, ast.Name):
                    yield rel, "call", child.func.id, child.lineno, owner, None, None
                elif isinstance(child.func, ast.Attribute) and isinstance(child.func.value, ast.Name):
                    yield rel, "call", child.func.value.id + ".", child.lineno, owner, None, None
            yield from walk(child, inner)

    seen: set = set()
    for fact in walk(parsed, 0):
        if fact[1] != "def" or (fact[2] not in seen and not seen.add(fact[2])):
            yield fact


def facts_of(rel: str, source: str) -> list[tuple]:
    """Facts of one file, as in FACTS, among them one of kind "engine": what read it."""
    extension = (re.search(r"\.[^./]*$", rel) or [""])[0]
    engine, found = "none", []
    if extension == ".py":
        try:
            engine, found = "parser", list(_by_parser(rel, ast.parse(source)))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            engine, found = "lines", list(_by_lines(rel, source))
    elif extension in scanner.LANGUAGES:
        engine, found = "scanner", [(rel, *f) for f in scanner.facts(source, extension)]
    return [(rel, "engine", engine, 0, None, None, None), *found]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            rows = [f for rel, text in zip(part.column("rel").to_pylist(), part.column("content").to_pylist(), strict=True) for f in facts_of(rel, text or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["rel", "kind", "name", "line", "owner", "spec", "orig"])


def engines(found: DataFrame) -> DataFrame:
    """engine, files: how many files each engine has read."""
    return found.filter("kind = 'engine'").groupBy(F.col("name").alias("engine")).agg(F.count("*").alias("files"))


def facts(files: DataFrame) -> DataFrame:
    """files(rel, content) -> FACTS, one row for each fact."""
    return files.select("rel", "content").mapInArrow(_facts, FACTS)


def _meant(aliases: dict[str, str | list[str]]) -> Column:
    """Places under the root that a specification may mean by the first alias that fits, longest prefix first; null if none fits. A name with *
    fits what begins and ends as it does, and what stands for * goes into its targets; a prefix with one folder fits all that begin with it."""
    meant = F.lit(None).cast("array<string>")
    for name, targets in sorted(((k if isinstance(v, list) else k + "*", v if isinstance(v, list) else [v + "*"]) for k, v in aliases.items()), key=lambda x: len(x[0].split("*")[0])):
        before, star, after = name.partition("*")
        fits = F.startswith("spec", F.lit(before)) & F.endswith("spec", F.lit(after)) if star else F.col("spec") == name
        middle = F.substring(F.col("spec"), F.lit(len(before) + 1), F.length("spec") - len(before) - len(after))
        places = [F.concat(F.lit(t.partition("*")[0]), middle, F.lit(t.partition("*")[2])) if star and "*" in t else F.lit(t) for t in targets]
        meant = F.when(fits, F.array(*places) if places else F.array().cast("array<string>")).otherwise(meant)
    return meant


def resolved_imports(found: DataFrame, files: DataFrame, aliases: dict[str, str | list[str]] | None = None) -> DataFrame:
    """Facts, files(rel) -> rel, spec, target. aliases: as _meant() has them; the one with the longest prefix decides, its targets are tried in order, and
    what none of them leads to stays unresolved."""
    specs = found.filter("kind in ('import', 'named') and spec is not null").select("rel", "spec").distinct()
    # An alias stands for a place under the root, wherever the file is.
    tried = specs.withColumn("meant", _meant(aliases or {})).withColumn("own", F.col("meant").isNull())
    tried = tried.select("rel", "spec", "own", F.posexplode(F.coalesce("meant", F.array("spec"))).alias("place", "at"))
    moved = tried.select(F.when(F.col("own"), F.col("rel")).otherwise(F.lit("")).alias("rel"), F.when(F.col("own"), F.col("at")).otherwise(F.concat(F.lit("./"), "at")).alias("spec"), F.col("rel").alias("file"), F.col("spec").alias("said"), "place")
    targets = tree.resolved(moved.select("rel", "spec").distinct(), files.select("rel"))
    first = moved.join(targets, ["rel", "spec"]).groupBy("file", "said").agg(F.min_by("target", "place").alias("target"))
    return first.select(F.col("file").alias("rel"), F.col("said").alias("spec"), "target").filter("rel <> target")


def call_edges(found: DataFrame, imports: DataFrame) -> DataFrame:
    """Facts and resolved imports -> rel, caller, line, target_rel, target: a call of a definition of the same file, else of
    what a named import brings from a file that defines or exports it; never of itself."""
    defs = found.filter("kind = 'def'").select("rel", "name", "line")
    names = defs.select("rel", "name").union(found.filter("kind = 'export'").select("rel", "name")).distinct()
    calls = found.filter("kind = 'call'").select("rel", F.rtrim("name", F.lit(".")).alias("name"), F.endswith("name", F.lit(".")).alias("qualified"), "line", "owner")
    owners = defs.select("rel", F.col("line").alias("owner"), F.col("name").alias("caller")).groupBy("rel", "owner").agg(F.min("caller").alias("caller"))
    calls = calls.join(owners, ["rel", "owner"], "left").withColumn("caller", F.coalesce("caller", F.lit(TOP)))
    local = defs.select("rel", "name", F.lit(True).alias("here"))
    named = found.filter("kind = 'named'").groupBy("rel", "name").agg(F.max_by(F.struct("spec", "orig"), "line").alias("n")).select("rel", "name", "n.spec", "n.orig").join(imports, ["rel", "spec"])
    brought = named.join(names.select(F.col("rel").alias("target"), F.col("name").alias("orig")), ["target", "orig"], "left_semi").select("rel", "name", "target", "orig")
    rows = calls.filter(F.col("caller") != F.col("name")).join(local, ["rel", "name"], "left").join(brought, ["rel", "name"], "left")
    here = F.col("here").isNotNull() & ~F.col("qualified")
    rows = rows.select("rel", "caller", "line", F.when(here, F.col("rel")).otherwise(F.col("target")).alias("target_rel"), F.when(here, F.col("name")).otherwise(F.col("orig")).alias("target"))
    return rows.filter("target is not null").filter("target_rel <> rel or target <> caller")


def modules(files: DataFrame, found: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """id, exports, imports, loc, degree, symbols(name, line, calls): one row for each file."""
    edges = imports.select(F.col("rel").alias("src"), F.col("target").alias("dst")).distinct()
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("incoming"))
    exports = found.filter("kind = 'export'").groupBy("rel", "name").agg(F.min("line").alias("line"))
    exports = exports.groupBy(F.col("rel").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]).alias("exports"))
    called = calls.groupBy("rel", F.col("caller").alias("name")).agg(F.array_sort(F.collect_set(F.concat_ws("::", "target_rel", "target"))).alias("calls"))
    symbols = found.filter("kind = 'def'").select("rel", "name", "line").join(called, ["rel", "name"], "full").select(F.col("rel").alias("id"), F.struct(F.coalesce("line", F.lit(0)).alias("line"), "name", F.coalesce("calls", F.array().cast("array<string>")).alias("calls")).alias("s"))
    symbols = symbols.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("symbols"))
    base = files.select(F.col("rel").alias("id"), F.size(F.split("content", "\n", -1)).alias("loc"))
    for part in (out, into, exports, symbols):
        base = base.join(part, "id", "left")
    none = F.array().cast("array<string>")
    return base.select("id", F.coalesce("exports", none).alias("exports"), F.coalesce("imports", none).alias("imports"), "loc", (F.size(F.coalesce("imports", none)) + F.coalesce("incoming", F.lit(0))).cast("long").alias("degree"), F.coalesce("symbols", F.array().cast("array<struct<line:int,name:string,calls:array<string>>>")).alias("symbols"))


def routes(found: DataFrame) -> DataFrame:
    """method, path, file, line, framework; at most ROUTES that a file says, and the one that its place makes."""
    rows = found.filter("kind = 'route'").withColumn("k", F.row_number().over(W.partitionBy("rel").orderBy("line", "name", "spec"))).filter(F.col("k") <= ROUTES)
    rows = rows.select(F.col("name").alias("method"), F.col("spec").alias("path"), F.col("rel").alias("file"), "line", F.col("orig").alias("framework"))
    places = found.filter("kind = 'engine'").select(F.lit("*").alias("method"), paths.file_route(F.col("rel")).alias("path"), F.col("rel").alias("file"), F.lit(1).alias("line"), F.lit("next").alias("framework"))
    return rows.unionByName(places.filter("path is not null"))
