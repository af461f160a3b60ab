"""Source trees: which files count, their text, definitions, imports, and the files that imports mean.

Patterns read one line at a time and see no nesting: a definition inside a comment or string counts too."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

# Extensions of code, folders and files left out (folders with a leading dot are left out by rule), largest file.
EXTENSIONS = [".ts", ".mts", ".cts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".java", ".go", ".rs", ".cs"]
IGNORED_FOLDERS = ["node_modules", "dist", "build", "out", "coverage", "vendor", "__pycache__", "venv"]
IGNORED_FILES = r"\.(min\.js|d\.ts|test\.[jt]sx?|spec\.[jt]sx?|stories\.[jt]sx?)$|(^|\/)(conftest|setup)\.py$"
LARGEST = 16_000_000

_SCRIPT = r"\b(?:function\*?|class|interface|const|let|var)\s+([A-Za-z_$][\w$]*)"
_METHOD = r"\b(?:class|interface|enum|record)\s+(\w+)|[\w>\]]\s+(\w+)\s*\([^;{}]*\)[^;{}=]*\{"
#: By family of extensions: a definition on a line, an import on a line. The first group that matched is the name.
DEFINITIONS = {r"\.[mc]?[jt]sx?$": _SCRIPT, r"\.py$": r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", r"\.(java|cs)$": _METHOD, r"\.go$": r"^\s*(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)", r"\.rs$": r"\b(?:fn|struct|enum|trait)\s+(\w+)"}
IMPORTS = {r"\.[mc]?[jt]sx?$": r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['"]([^'"]+)['"]""", r"\.py$": r"^\s*(?:from\s+(\S+)\s+import\b|import\s+([\w.]+))", r"\.java$": r"^\s*import\s+(?:static\s+)?([\w.*]+)", r"\.cs$": r"^\s*using\s+([\w.]+)\s*;", r"\.go$": r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"', r"\.rs$": r"^\s*(?:pub\s+)?use\s+([\w:]+)"}
_NOT_NAMES = ["if", "for", "while", "switch", "catch", "return", "new", "else"]


def is_code(rel: Column) -> Column:
    """Whether a relative path is a source file that a scan takes."""
    folders = F.slice(F.split(rel, "/"), F.lit(1), F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    hidden = F.exists(F.split(rel, "/"), lambda s: s.startswith("."))
    return F.regexp_extract(rel, r"\.[^./]+$", 0).isin(EXTENSIONS) & ~hidden & ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_FOLDERS))) & ~rel.rlike(IGNORED_FILES)


def scan(spark: SparkSession, root: str, ignored: DataFrame | None = None) -> DataFrame:
    """rel, size, content of the code under a root. ignored(path): files, or folders that end in a slash, left out.

    Name and size are tested before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root if "://" in root or root.startswith("file:") else "file:" + root
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + _quoted(base.replace("file://", "file:").rstrip("/")) + "/", "")
    rows = files.withColumn("rel", rel).filter((F.col("length") <= LARGEST) & is_code(F.col("rel")))
    if ignored is not None:
        hit = (F.col("rel") == F.col("path")) | (F.col("path").endswith("/") & F.startswith("rel", F.col("path")))
        rows = rows.drop("path").join(ignored.select("path"), hit, "left_anti")
    return rows.select("rel", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def _quoted(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def _on_lines(files: DataFrame, patterns: dict[str, str], name: str) -> DataFrame:
    lines = files.select("rel", F.posexplode(F.split("content", r"\r?\n", -1)).alias("pos", "text"))
    match = lambda p: F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(i + 1)) for i in range(re.compile(p).groups)]))
    found = reduce(lambda out, x: F.when(F.col("rel").rlike(x[0]), match(x[1])).otherwise(out), patterns.items(), F.array().cast("array<string>"))
    return lines.select("rel", (F.col("pos") + 1).alias("line"), F.explode(found).alias(name)).filter(f"{name} <> ''")


def definitions(files: DataFrame) -> DataFrame:
    """files(rel, content) -> rel, name, line: where a name is defined first in its file."""
    return _on_lines(files, DEFINITIONS, "name").filter(~F.col("name").isin(_NOT_NAMES)).groupBy("rel", "name").agg(F.min("line").alias("line"))


def imports(files: DataFrame) -> DataFrame:
    """files(rel, content) -> rel, spec."""
    return _on_lines(files, IMPORTS, "spec").select("rel", "spec").distinct()


def resolved(specs: DataFrame, files: DataFrame) -> DataFrame:
    """specs(rel, spec), files(rel) -> rel, spec, target: the file a relative import means, by first candidate there is."""
    folder = F.regexp_replace("rel", "[^/]*$", "")
    dots = F.length(F.regexp_extract("spec", r"^\.+", 0))
    python = F.concat(F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise(""), F.translate(F.regexp_replace("spec", r"^\.+", ""), ".", "/"))
    base = paths.normalised(F.concat(folder, F.when(F.col("rel").endswith(".py") & ~F.col("spec").contains("/"), python).otherwise(F.col("spec"))))
    # A specification may name the extension that the compiler writes instead of the source's.
    stem = F.regexp_replace(base, r"\.[mc]?jsx?$", "")
    candidates = F.concat(F.array(base), *[F.array(*[F.concat(x, F.lit(e)) for e in EXTENSIONS]) for x in (stem, base)], F.array(*[F.concat(base, F.lit("/index" + e)) for e in EXTENSIONS[:8]]), F.array(F.concat(base, F.lit("/__init__.py"))))
    tried = specs.filter(F.col("spec").startswith(".")).select("rel", "spec", F.posexplode(candidates).alias("priority", "target"))
    return tried.join(files.select(F.col("rel").alias("target")), "target").groupBy("rel", "spec").agg(F.min_by("target", "priority").alias("target"))


def listing(spark: SparkSession, root: str, ignored: DataFrame | None = None) -> DataFrame:
    """Paths of the code under a root in order, without reading contents."""
    return scan(spark, root, ignored).select("rel").orderBy("rel")
