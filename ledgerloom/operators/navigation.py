"""Places in code that a question means, from modules(id, imports, symbols(name, line, calls)) and routes(method, path, file, line)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Modules named in full, their imports and importers shown, definitions, callers and routes shown; the share of the
# best score, the length and the frequency that matter; most that words of the path add.
NAMED, IMPORTS, IMPORTERS, SHOWN, CALLERS, ROUTES, SHARE, LONG, RARE, PATH = 3, 8, 12, 3, 2, 3, 0.3, 5, 3, 2
# What asks for a form of answer, and what asks for imports.
_FORM = re.compile(r"\b(?:return|retourne[zr]?|respond|do not|ne modifie[zr]?)\b", re.IGNORECASE)
_ABOUT_IMPORTS = re.compile(r"\b(import|dependenc|module|orchestrat)", re.IGNORECASE)

OUTPUT = "position int, kind string, name string, file string, line int"


def _terms(spark, said: list[str]) -> list[list[str]]:
    rows = spark.createDataFrame(list(enumerate(said)), "k int, t string").select("k", text.navigation_terms(F.col("t")).alias("w"))
    return [r.w for r in rows.orderBy("k").collect()]


def ranked(modules: DataFrame, query: list[str], primary: list[str]) -> DataFrame:
    """file, name, line, hits, score of definitions: rare words of the question in the name weigh more, words in the path add a
    little. One hit is enough only for a long and rare word of the first sentence; a path alone is never."""
    asked = F.array(*map(F.lit, query))
    rows = modules.select(F.col("id").alias("file"), F.explode("symbols").alias("s")).filter("s.name <> '(module)'").select("file", "s.name", "s.line", "s.calls")
    rows = rows.withColumns({"words": text.navigation_terms(F.col("name")), "path": text.navigation_terms(F.col("file"))})
    total = rows.agg(F.count("*").alias("all"))
    often = rows.select(F.explode(F.array_intersect("words", asked)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    often = often.agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("often"))  # one entry for a word of the question at most
    hits = F.filter(asked, lambda t: F.array_contains("words", t) | (t.rlike(r"\d") & F.contains(F.lower("name"), t)))
    rows = rows.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(often)).withColumn("hits", hits)
    times = lambda t, none: F.coalesce(F.try_element_at("often", t), F.lit(none))
    first = F.array(*map(F.lit, primary)) if primary else F.array().cast("array<string>")
    anchored = (F.size("hits") >= 2) | F.exists("hits", lambda t: F.array_contains(first, t) & (F.length(t) >= LONG) & (times(t, 0) <= RARE))
    weight = F.aggregate("hits", F.lit(0.0), lambda s, t: s + F.log(1 + F.col("all") / times(t, 1)))
    along = F.least(F.lit(PATH), F.size(F.array_intersect("path", asked)))
    return rows.filter(anchored).select("file", "name", "line", "calls", "hits", (weight + along).alias("score"))


def covering(best: list, shown: int = SHOWN) -> list:
    """Rows(score, file, hits), best first -> those that bring a new word from a new file and score enough, `shown` at most."""
    files, words, out = set(), set(), []
    for r in best:
        if r.score < best[0].score * SHARE or r.file in files or words.issuperset(r.hits):
            continue
        files.add(r.file)
        words.update(r.hits)
        out.append(r)
    return out[:shown]


def navigate(modules: DataFrame, routes: DataFrame, prompt: str) -> DataFrame:
    """position, kind, name, file, line: modules that the prompt names, with imports and importers; else definitions that cover its words,
    their imports if it asks for them, callers of the first one; and routes that match."""
    spark = modules.sparkSession
    question = _FORM.split(prompt)[0]
    query, primary = _terms(spark, [question, re.split(r"[.!?](?:\s|$)", question)[0]])
    out: list[tuple] = []

    def add(kind: str, name: str | None, file: str | None, line: int | None = None) -> None:
        out.append((len(out), kind, name, file, line))

    if query:
        said = F.lit(prompt.replace("\\", "/"))
        named = modules.filter(F.contains(said, F.col("id"))).orderBy("id").limit(NAMED).select("id", F.slice("imports", 1, IMPORTS).alias("imports")).collect()
        for m in named:
            add("module", None, m.id)
            for f in m.imports:
                add("imports", None, f)
            into = modules.filter(F.array_contains("imports", m.id))
            for r in into.select("id").orderBy("id").limit(IMPORTERS).collect():
                add("imported by", None, r.id)
            more = into.count() - IMPORTERS
            if more > 0:
                add("more importers", str(more), None)
        if not named:
            _definitions(modules, routes, question, query, primary, add)
    return spark.createDataFrame(out, OUTPUT)


def _definitions(modules: DataFrame, routes: DataFrame, question: str, query: list[str], primary: list[str], add) -> None:
    order = (F.desc("score"), "file", "line", "name")
    candidates = ranked(modules, query, primary)
    best = candidates.orderBy(*order).limit(1).collect()
    if best:
        # Of one file and one set of hits only the best can be taken, so few rows are gathered.
        enough = candidates.filter(F.col("score") >= best[0].score * SHARE).withColumn("key", F.struct("score", -F.col("line")))
        few = enough.groupBy("file", "hits").agg(F.max("score").alias("score"), F.max_by(F.struct("name", "line"), "key").alias("d"))
        top = covering(few.select("file", "hits", "score", "d.name", "d.line").orderBy(*order).collect())
        for r in top:
            add("definition", r.name, r.file, r.line)
        if _ABOUT_IMPORTS.search(question):
            for r in modules.filter(F.col("id") == best[0].file).select(F.explode(F.slice("imports", 1, SHOWN)).alias("f")).collect():
                add("imports", None, r.f)
        target = f"{best[0].file}::{best[0].name}"
        calls = modules.select(F.col("id").alias("file"), F.explode("symbols").alias("s")).filter(F.array_contains("s.calls", target) & (F.col("s.name") != "(module)"))
        for r in top:
            calls = calls.filter((F.col("file") != r.file) | (F.col("s.line") != r.line))
        for r in calls.select("s.name", "file", "s.line").orderBy("file", "line").limit(CALLERS).collect():
            add("caller", r.name, r.file, r.line)
    if not best or best[0].file.startswith("app/"):
        hits = F.array_intersect(F.array(*map(F.lit, query)), text.navigation_terms(F.col("path")))
        found = routes.withColumn("hits", hits).filter(F.exists("hits", lambda t: F.length(t) >= LONG))
        for r in found.orderBy(F.desc(F.size("hits")), "file", "path").limit(ROUTES).collect():
            add("route", f"{r.method} {r.path}", r.file, r.line)
