"""Queries on paths, links and routes of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..workload import query

_HREFS = "unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))"
_PATH = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"
# Numbers of the table's paths become parameters, written in one of three ways; every seventh page has no path.
_ROUTED = f"CASE WHEN page_id % 7 = 0 THEN '/' ELSE regexp_replace({_PATH}, '/[0-9]+', CASE page_id % 3 WHEN 0 THEN '/:Id' WHEN 1 THEN '/{{name}}' ELSE '/[slug]' END, 'g') END"
_PARTS = rf"list_filter(string_split(lower(regexp_replace({_ROUTED}, ':(\w+)|\{{(\w+)\}}|\[(\w+)\]', ':p', 'g')), '/'), lambda s: s <> '')"
_SIMILAR = "CASE WHEN len(s) = 0 THEN 0 ELSE round(2.0 * len(list_filter(range(1, least(len(s), 2) + 1), lambda i: s[i] = (['fr', ':p'])[i])) / (len(s) + 2), 6) END"
_FILES = r"regexp_extract_all(text, '[A-Za-z0-9_/-]+\.[a-z]{2,4}\b')"
ALIASES = {"/t": "/T", "/th": "/Th", "/qu": "/Qu", "/que": "/que"}


def _links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(paths.links(F.col("html"))).alias("spec")).distinct()


def _routed(pages: DataFrame) -> DataFrame:
    """page_id, route: paths as routes with parameters."""
    put = F.when(F.col("page_id") % 3 == 0, F.lit("/:Id")).when(F.col("page_id") % 3 == 1, F.lit("/{name}")).otherwise(F.lit("/[slug]"))
    return pages.select("page_id", "url", F.when(F.col("page_id") % 7 == 0, F.lit("/")).otherwise(F.regexp_replace(paths.url_path(F.col("url")), F.lit("/[0-9]+"), put)).alias("route"))


def _known(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("url").contains("/en/")).select(F.explode(paths.links(F.col("html"))).alias("path")).distinct()


@query("pages", sql=f"WITH s AS (SELECT DISTINCT page_id, {_HREFS} AS spec FROM pages), k AS (SELECT DISTINCT {_HREFS} AS path FROM pages WHERE contains(url, '/en/')), c AS (SELECT page_id, spec, 0 AS p, spec AS c FROM s UNION ALL SELECT page_id, spec, 1, lower(spec) FROM s UNION ALL SELECT page_id, spec, 2, regexp_replace(spec, '[^A-Za-z]+$', '') FROM s) SELECT page_id, spec, arg_min(path, p) AS path FROM c JOIN k ON c = path GROUP BY 1, 2")
def link_resolution(pages: DataFrame) -> DataFrame:
    """Links to known paths: as written, else in lower case, else without marks at the end."""
    forms = F.array(F.col("spec"), F.lower("spec"), F.regexp_replace("spec", "[^A-Za-z]+$", ""))
    tried = _links(pages).select("page_id", "spec", F.posexplode(forms).alias("priority", "path"))
    return tried.join(_known(pages), "path").groupBy("page_id", "spec").agg(F.min_by("path", "priority").alias("path"))


@query("pages", sql=f"WITH s AS (SELECT DISTINCT {_HREFS} AS spec FROM pages), k AS (SELECT DISTINCT {_HREFS} AS path FROM pages WHERE contains(url, '/en/')), a AS (SELECT spec, CASE WHEN starts_with(spec, '/que') THEN '/que' || substr(spec, 5) WHEN starts_with(spec, '/th') THEN '/Th' || substr(spec, 4) WHEN starts_with(spec, '/qu') THEN '/Qu' || substr(spec, 4) WHEN starts_with(spec, '/t') THEN '/T' || substr(spec, 3) END AS target FROM s) SELECT spec, target, path IS NOT NULL AS found FROM a LEFT JOIN k ON path = target WHERE target IS NOT NULL")
def alias_resolution(pages: DataFrame) -> DataFrame:
    """The longest alias decides, also where its target is not there."""
    targets = _links(pages).select("spec", paths.aliased(F.col("spec"), ALIASES).alias("target")).filter("target is not null").distinct()
    known = _known(pages).withColumnRenamed("path", "target").withColumn("known", F.lit(True))
    return targets.join(known, "target", "left").select("spec", "target", F.col("known").isNotNull().alias("found"))


@query("pages", sql=r"SELECT page_id, p AS path, NOT regexp_matches(p, '^/|(^|/)\.\.(/|$)|\\|^[A-Za-z]:|[\x00-\x1f]') AND length(p) <= 200 AND p <> '' AS relative FROM (SELECT page_id, substr(" + _PATH + ", 2) AS p FROM pages)")
def path_predicates(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.substring(paths.url_path(F.col("url")), 2, 1 << 30).alias("path"))
    return rows.withColumn("relative", paths.is_relative(F.col("path")))


@query("documents", sql=f"SELECT doc_id, array_to_string((list_filter({_FILES}, lambda x, i: list_position({_FILES}, x) = i))[1:20], ' ') AS files FROM documents WHERE len({_FILES}) > 0")
def cited_files(documents: DataFrame) -> DataFrame:
    found = documents.select("doc_id", paths.cited_files(F.col("text")).alias("f"))
    return found.filter(F.size("f") > 0).select("doc_id", F.array_join("f", " ").alias("files"))


@query("pages", sql=f"WITH r AS (SELECT page_id, {_PARTS} AS s FROM pages) SELECT page_id, {_SIMILAR} AS similarity FROM r")
def route_similarity(pages: DataFrame) -> DataFrame:
    return _routed(pages).select("page_id", F.round(_likeness(), 6).alias("similarity"))


def _likeness():
    """Of a route to /fr/:p."""
    return paths.route_similarity(paths.route_parts(F.col("route")), paths.route_parts(F.lit("/fr/:p")))


@query("pages", sql=f"WITH r AS (SELECT page_id, {_PARTS} AS s FROM pages) SELECT page_id, {_SIMILAR} AS similarity FROM r WHERE {_SIMILAR} >= 0.6 ORDER BY similarity DESC, page_id LIMIT 5")
def similar_routes(pages: DataFrame) -> DataFrame:
    """The five routes most like a given one, from a similarity of 0.6 on."""
    rows = _routed(pages).select("page_id", F.round(_likeness(), 6).alias("similarity")).filter("similarity >= 0.6")
    return rows.orderBy(F.desc("similarity"), "page_id").limit(5)


@query("pages", sql=f"WITH r AS (SELECT page_id, url, {_PARTS} AS s FROM pages) SELECT page_id, round({_SIMILAR} + CASE WHEN contains(url, 'th') THEN 1 ELSE 0 END, 6) AS score FROM r ORDER BY score DESC, page_id LIMIT 6")
def relevant_routes(pages: DataFrame) -> DataFrame:
    score = F.round(F.round(_likeness(), 6) + F.col("url").contains("th").cast("int"), 6)
    return _routed(pages).select("page_id", score.alias("score")).orderBy(F.desc("score"), "page_id").limit(6)


@query("pages", sql=f"SELECT page_id, regexp_replace({_PATH}, '/[0-9]+', '/:id', 'g') AS route, len(string_split(substr(html, 1, strpos(html, '</article>')), chr(10))) AS line, substr(string_split(regexp_extract(html, '<h1>([^<]*)', 1), '.')[1], 1, 120) AS signature FROM pages")
def string_helpers(pages: DataFrame) -> DataFrame:
    route = F.regexp_replace(paths.url_path(F.col("url")), "/[0-9]+", "/:id")
    heading = F.substring_index(F.regexp_extract("html", "<h1>([^<]*)", 1), ".", 1)
    return pages.select("page_id", route.alias("route"), paths.line_of(F.col("html"), F.locate("</article>", F.col("html"))).cast("long").alias("line"), F.substring(heading, 1, 120).alias("signature"))


@query("documents", sql="WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(list_distinct(w)) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(w))[1:3], '|') AS low, list_contains(w, 'the') AS has, len(list_filter(w, lambda x: length(x) = 0)) = 0 AS filled FROM w")
def array_functions(documents: DataFrame) -> DataFrame:
    words = documents.filter("text is not null").select("doc_id", F.split(F.lower("text"), " ", -1).alias("w")).withColumn("d", F.array_distinct("w"))
    return words.select("doc_id", F.size("d").cast("long").alias("n"), F.array_join(F.slice(F.array_sort("d"), 1, 3), "|").alias("low"), F.array_contains("w", "the").alias("has"), F.forall("w", lambda x: F.length(x) > 0).alias("filled"))


@query("pages", sql="WITH h AS (SELECT contains(url, '/en/') AS en, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) AS h FROM pages) SELECT CAST(sum(h) AS BIGINT) AS listed, CAST(sum(h) FILTER (en) AS BIGINT) AS indexed, sum(h) IS DISTINCT FROM sum(h) FILTER (en) AS stale FROM h")
def fingerprint_staleness(pages: DataFrame) -> DataFrame:
    """Sums of hashes tell two listings apart without sorting or gathering them."""
    h = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 8), 16, 10).cast("long")
    sums = pages.agg(F.sum(h).alias("listed"), F.sum(F.when(F.col("url").contains("/en/"), h)).alias("indexed"))
    return sums.withColumn("stale", ~F.col("listed").eqNullSafe(F.col("indexed")))
