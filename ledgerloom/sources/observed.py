"""What tools did, as sessions see it; alias configuration of a source tree; neighbours kept for words; journals that rotate."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import retrieval

# Targets of one use of a tool, lengths of a path and a command, neighbours of a word, words looked through.
TARGETS, PATH, COMMAND, NEIGHBOURS, SCANNED = 32, 1000, 2000, 40, 20_000
#: Fixed value: how a patch names the files that it changes.
_PATCHED = r"(?m)^\*\*\* (?:Update File|Add File|Delete File|Move to): (.+)$"
_COMMENTS = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)


def observations(uses: DataFrame, root: str) -> DataFrame:
    """uses(id, tool, input JSON, response JSON, failed) -> id, tool, targets, outside, command, exit_code, failed: the files under a root that a tool
    named, whether it named others, and how it ended by its own status alone."""
    field = lambda c, *names: F.coalesce(*(F.get_json_object(c, f"$.{n}") for n in names))
    patch = F.when(F.col("tool") == "apply_patch", field("input", "patch", "input", "command"))
    named = F.concat(F.array(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.path")), F.coalesce(F.transform(F.regexp_extract_all(patch, F.lit(_PATCHED), F.lit(1)), F.trim), F.array().cast("array<string>")))
    said = F.filter(F.transform(named, lambda p: F.replace(p, F.lit("\\"), F.lit("/"))), lambda p: p.isNotNull() & (F.trim(p) != "") & (F.length(p) <= PATH))
    top = root.rstrip("/")
    whole = F.transform(said, lambda p: paths.absolute(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(top + "/"), p))))
    inside = F.transform(F.filter(whole, lambda p: p.startswith(top + "/")), lambda p: F.substring(p, len(top) + 2, 1 << 30))
    outside = F.exists(whole, lambda p: ~(p.startswith(top + "/") | (p == top) | p.rlike(r"(^|/)\.[a-z]+/projects/[^/]+/memory/")))
    command, code = field("input", "command", "cmd"), field("response", "exit_code", "exitCode").cast("long")
    bad = F.col("failed") | F.coalesce(field("response", "is_error", "isError") == "true", F.lit(False)) | F.coalesce(code != 0, F.lit(False))
    return uses.select("id", "tool", F.slice(F.array_distinct(inside), 1, TARGETS).alias("targets"), outside.alias("outside"), F.when((F.col("tool") != "apply_patch") & (F.length(command) <= COMMAND), command).alias("command"), code.alias("exit_code"), bad.alias("failed"))


def alias_targets(read: Callable[[str], str | None], file: str = "tsconfig.json") -> dict[str, list[str]]:
    """Names of modules, with * for a part of them, and the places that they may mean, in order, from a configuration and those it extends; a later one
    overrides an earlier one, a file that extends itself counts once, one that can't be read not at all. Few small files, read by the driver."""

    def one(path: str, seen: set[str]) -> tuple[str | None, dict]:
        text = None if path in seen else read(path)
        seen.add(path)
        try:
            raw = json.loads(_COMMENTS.sub(lambda m: m[1] or "", text or ""))
        except ValueError:
            return None, {}
        if not isinstance(raw, dict):
            return None, {}
        base, found, folder = None, {}, posixpath.dirname(path)
        parents = raw.get("extends")
        for parent in parents if isinstance(parents, list) else [parents]:
            if isinstance(parent, str) and parent.startswith("."):
                up = posixpath.normpath(posixpath.join(folder, parent))
                from_base, from_paths = one(up if posixpath.splitext(up)[1] else up + ".json", seen)
                base, found = from_base or base, from_paths or found
        options = raw.get("compilerOptions") or {}
        if isinstance(options.get("baseUrl"), str):
            base = posixpath.normpath(posixpath.join(folder, options["baseUrl"]))
        if isinstance(options.get("paths"), dict):
            at = base if base is not None else folder
            found = {k: [posixpath.normpath(posixpath.join(at, x)).removeprefix("./") for x in v if isinstance(x, str)] for k, v in options["paths"].items() if isinstance(v, list)}
        return base, found

    return one(file, set())[1]


def aliases_of(read: Callable[[str], str | None], file: str = "tsconfig.json") -> dict[str, str]:
    """Prefixes of module names and the first folder that each stands for."""
    return {k.split("*")[0]: v[0].split("*")[0] for k, v in alias_targets(read, file).items() if v}


def neighbours(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """words(word), vectors(word, row, vec) -> word, near array<struct<s, word>>: the closest words of the first rows of a table, to be kept beside it. The
    words asked are a stated set; the table is bounded by SCANNED."""
    table = vectors.filter(F.col("row") < SCANNED).select(F.col("word").alias("other"), F.col("vec").alias("v"))
    asked = words.join(vectors, "word").select("word", "vec")
    # Each asked word meets the bounded table; of each task's rows only the best go on.
    s = retrieval.dot(F.col("vec"), F.col("v")) / (127.0 * 127.0)
    pairs = table.join(asked, F.col("other") != F.col("word")).select("word", F.struct(F.round(s, 6).alias("s"), F.col("other").alias("word")).alias("x"))
    best = F.slice(F.sort_array(F.collect_list("x"), False), 1, NEIGHBOURS)
    return pairs.groupBy("word", F.pmod(F.xxhash64("x.word"), F.lit(64)).alias("part")).agg(best.alias("x")).groupBy("word").agg(F.slice(F.sort_array(F.flatten(F.collect_list("x")), False), 1, NEIGHBOURS).alias("near"))


def rotate(spark: SparkSession, path: str, most: int) -> bool:
    """Moves a journal's folder to `path`.old, over an older one, if it has more than so many bytes."""
    jvm = spark.sparkContext._jvm
    now, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".old"))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(now) or fs.getContentSummary(now).getLength() <= most:
        return False
    fs.delete(old, True)
    return fs.rename(now, old)
