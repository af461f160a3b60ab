"""What a change touches: from modules(id, imports, symbols(name, line, calls)) and routes(method, path, file, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph

# Nodes reached with the target, symbols and routes shown, depth.
NODES, SYMBOLS, ROUTES, DEPTH = 400, 60, 40, 4


def symbol_edges(modules: DataFrame) -> DataFrame:
    """src, dst: called symbol and symbol that calls it, as file::name."""
    rows = modules.select("id", F.explode("symbols").alias("s"))
    return rows.select(F.explode("s.calls").alias("src"), F.concat_ws("::", "id", "s.name").alias("dst"))


def file_edges(modules: DataFrame) -> DataFrame:
    """src, dst: imported file and file that imports it."""
    return modules.select(F.explode("imports").alias("src"), F.col("id").alias("dst"))


def resolve_target(modules: DataFrame, query: str) -> tuple[str, str] | None:
    """(id, kind) of `file::symbol`, a file's id, the one path that ends so, or the one symbol of that name."""
    said = query.strip().replace("\\", "/")
    if "::" in said:
        file, name = said.split("::")[:2]
        own = modules.filter((F.col("id") == file) | F.endswith("id", F.lit("/" + file))).orderBy((F.col("id") != file).cast("int"), "id").limit(1)
        found = own.filter(F.exists("symbols", lambda s: s["name"] == name)).select("id").collect()
        return (f"{found[0].id}::{name}", "symbol") if found else None
    # Each rule by itself: of a rule with several answers none counts.
    exact, suffix, owner = F.col("id") == said, F.endswith("id", F.lit(said)), F.exists("symbols", lambda s: s["name"] == said)
    rows = modules.agg(*(x for c in (exact, suffix, owner) for x in (F.count_if(c), F.min(F.when(c, F.col("id")))))).first()
    if rows[0]:
        return rows[1], "file"
    if rows[2] == 1:
        return rows[3], "file"
    return (f"{rows[5]}::{said}", "symbol") if rows[4] == 1 else None


def impact(modules: DataFrame, routes: DataFrame, target: str, kind: str, depth: int = DEPTH) -> dict[str, DataFrame]:
    """files(depth, file), symbols(symbol, depth, via), routes(method, path, file), summary(direct, transitive, truncated).

    Nodes count in order of depth and name, NODES at most with the target; steps beyond them are not taken."""
    spark = modules.sparkSession
    start = spark.createDataFrame([(target,)], "node string")
    if kind == "symbol":
        found = graph.reach_within(symbol_edges(modules), start, depth, NODES)
        symbols = found.filter("depth > 0").select(F.col("node").alias("symbol"), "depth", "via")
        files = symbols.groupBy(F.substring_index("symbol", "::", 1).alias("file")).agg(F.min("depth").alias("depth")).filter(F.col("file") != target.split("::")[0])
        touched = files.select("file").union(spark.createDataFrame([(target.split("::")[0],)], "file string")).distinct()
    else:
        found = graph.reach_within(file_edges(modules), start, depth, NODES)
        files = found.filter("depth > 0").select(F.col("node").alias("file"), "depth")
        touched = files.select("file")
        own = modules.filter(F.col("id") == target).select(F.explode("symbols").alias("s")).select(F.concat(F.lit(target + "::"), F.col("s.name")).alias("src"))
        symbols = symbol_edges(modules).join(own, "src", "left_semi").select(F.col("dst").alias("symbol"), F.lit(1).alias("depth"), F.col("src").alias("via"))
    symbols = symbols.orderBy("depth", "via", "symbol").limit(SYMBOLS)
    routed = routes.join(touched, "file", "left_semi").select("method", "path", "file").orderBy("path", "method", "file").limit(ROUTES)
    summary = files.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("transitive")).crossJoin(found.agg(F.coalesce(F.bool_or("cut"), F.lit(False)).alias("truncated")))
    return {"files": files, "symbols": symbols, "routes": routed, "summary": summary}


def layers(files: DataFrame) -> DataFrame:
    """files(depth, file) -> depth, files in order."""
    return files.groupBy("depth").agg(F.array_sort(F.collect_list("file")).alias("files"))


def routes_by_framework(routes: DataFrame, shown: int = 80) -> DataFrame:
    """framework, method, path, file, line, more: the first ones of each framework and how many more there are."""
    every = routes.groupBy(F.col("framework").alias("of")).agg(F.count("*").alias("all"))
    # The first ones alone, so that tasks drop the others before they are dealt by framework.
    rows = routes.withColumn("k", F.row_number().over(W.partitionBy("framework").orderBy("path", "method", "file", "line"))).filter(F.col("k") <= shown)
    rows = rows.join(F.broadcast(every), F.col("framework").eqNullSafe(F.col("of")))
    return rows.select("framework", "method", "path", "file", "line", F.greatest(F.col("all") - shown, F.lit(0)).alias("more"))


def report(modules: DataFrame, routes: DataFrame) -> str:
    """The architecture as Markdown: domains, modules with many edges, routes by framework. What is gathered is bounded: 12 domains, 10
    modules, 80 routes of a framework."""
    top = F.when(F.col("id").contains("/"), F.substring_index("id", "/", 1)).otherwise(F.lit("(root)"))
    domains = modules.groupBy(top.alias("name")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).orderBy(F.desc("loc"), "name").limit(12).collect()
    gods = modules.orderBy(F.desc("degree"), "id").limit(10).filter("degree >= 5").collect()
    out = ["# Architecture", "", "## Domains", *(f"- **{d['name']}**: {d.files} files, {d.loc:,} lines" for d in domains), ""]
    out += ["## Modules with many edges", *(f"- `{g.id}`: {g.degree} edges" for g in gods), ""] if gods else []
    out.append(f"## Routes ({routes.count()})")
    last = None
    for r in routes_by_framework(routes).orderBy("framework", "path", "method", "file", "line").collect():
        if r.framework != last:
            if last is not None and more:
                out.append(f"- and {more} more")
            out += ["", f"### {r.framework}"]
        last, more = r.framework, r.more
        out.append(f"- `{r.method:<6} {r.path}` in {r.file}:{r.line}")
    if last is not None and more:
        out.append(f"- and {more} more")
    return "\n".join(out) + "\n"


def shapes(modules: DataFrame) -> DataFrame:
    """file, shape, loc: hashes of what a module exports, imports and defines, in order, 500 at most."""
    named = lambda kind, names: F.transform(names, lambda x: F.concat(F.lit(kind + ":"), x))
    facts = F.concat(named("export", F.col("exports")), named("import", F.col("imports")), named("symbol", F.transform("symbols", lambda s: s["name"])))
    return modules.select(F.col("id").alias("file"), F.transform(F.slice(F.array_sort(F.array_distinct(facts)), 1, 500), lambda x: F.sha2(x.cast("binary"), 256)).alias("shape"), "loc")


def drift(before: DataFrame, now: DataFrame, there: DataFrame) -> DataFrame:
    """before(key, file, shape, loc), now(file, shape, loc), there(file) -> key, state, similarity.

    A file that is gone makes a key `missing`; one without a present shape `unknown`; else the lowest of shared shape and
    of size over its files tells `unchanged` (1) from `changed`."""
    rows = before.join(there.select("file", F.lit(True).alias("there")), "file", "left").join(now.select("file", F.col("shape").alias("new"), F.col("loc").alias("lines")), "file", "left")
    union = F.size(F.array_union("shape", "new"))
    shared = F.when(union > 0, F.size(F.array_intersect("shape", "new")) / union).otherwise(1.0)
    size = F.when(F.greatest("loc", "lines") > 0, F.least("loc", "lines") / F.greatest("loc", "lines")).otherwise(1.0)
    each = rows.select("key", F.col("there").isNull().alias("gone"), F.col("new").isNull().alias("unseen"), F.least(shared, size).alias("like"))
    out = each.groupBy("key").agg(F.bool_or("gone").alias("gone"), F.bool_or("unseen").alias("unseen"), F.min("like").alias("like"))
    state = F.when(F.col("gone"), "missing").when(F.col("unseen"), "unknown").when(F.col("like") == 1, "unchanged").otherwise("changed")
    return out.select("key", state.alias("state"), F.when(F.col("gone"), 0.0).when(~F.col("unseen"), F.col("like")).alias("similarity"))
