"""Queries on records: states, windows, chains, checks, shapes, names and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import graph, selection
from ..workload import query
from .graph import _EDGES, edges
from .history import order_relations

STATES, PRIORITIES = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("orders", sql="SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_orderstatus = 'O'")
def heads_in_state(orders: DataFrame) -> DataFrame:
    """The newest version of each key, if it is in one state: the state is tested after the newest is chosen."""
    newest = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("h")
    return orders.groupBy("o_custkey").agg(newest).filter("h.o_orderstatus = 'O'").select("o_custkey", "h.o_orderkey")


_ZONE = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_PLACE = "regexp_extract(url, '^https?://([^?#]+)', 1)"


@query("pages", sql=f"WITH z AS (SELECT DISTINCT {_ZONE} AS zone FROM pages WHERE page_id % 5 = 0 UNION SELECT DISTINCT {_PLACE} FROM pages WHERE page_id % 7 = 0), p AS (SELECT page_id, {_PLACE} AS place FROM pages) SELECT page_id, zone, CASE WHEN place = zone THEN 6 ELSE least(len(string_split(zone, '/')), 5) END AS depth FROM p JOIN z ON place = zone OR starts_with(place, zone || '/') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY depth DESC, zone) = 1")
def narrowest_zone(pages: DataFrame) -> DataFrame:
    """Each place with the narrowest zone that holds it: its ancestors meet the zones by equality, no prefix is compared."""
    place = F.regexp_extract("url", "^https?://([^?#]+)", 1)
    zones = pages.filter("page_id % 5 = 0").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("zone")).union(pages.filter("page_id % 7 = 0").select(place)).distinct()
    parts = F.split(place, "/", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = pages.select("page_id", place.alias("place"), F.explode(ancestors).alias("zone")).join(zones, "zone")
    depth = F.when(F.col("place") == F.col("zone"), 6).otherwise(F.least(F.size(F.split("zone", "/", -1)), F.lit(5)))
    return rows.withColumn("depth", depth).groupBy("page_id").agg(F.min_by(F.struct("zone", "depth"), F.struct(-F.col("depth"), "zone")).alias("b")).select("page_id", "b.zone", "b.depth")


_SAID = "'see ./' || regexp_extract(url, '(en|fr|de|es)/[0-9]+', 0) || '.html, ../up/' || page_id || '.py or zz/' || page_id || '.ts'"


@query("pages", sql=rf"WITH c AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all({_SAID}, '(?:\.{{0,2}}/)?[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*/[A-Za-z0-9_.-]+\.[a-z]+'), lambda p: regexp_replace(p, '^\./', '')))) AS path FROM pages), k AS (SELECT DISTINCT regexp_extract(url, '/(en|fr|de|es)/', 1) AS top FROM pages) SELECT page_id, path FROM c WHERE NOT contains(path, '..') AND split_part(path, '/', 1) IN (SELECT top FROM k)")
def cited_paths(pages: DataFrame) -> DataFrame:
    """Paths that a text names, without those that leave the root and those whose first folder is not there."""
    said = F.concat(F.lit("see ./"), F.regexp_extract("url", "(en|fr|de|es)/[0-9]+", 0), F.lit(".html, ../up/"), "page_id", F.lit(".py or zz/"), "page_id", F.lit(".ts"))
    found = F.regexp_extract_all(said, F.lit(r"(?:\.{0,2}/)?[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*/[A-Za-z0-9_.-]+\.[a-z]+"), F.lit(0))
    cited = pages.select("page_id", F.explode(F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"^\./", "")))).alias("path")).filter("not contains(path, '..')")
    tops = pages.select(F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("top")).distinct()
    return cited.withColumn("top", F.split_part("path", F.lit("/"), F.lit(1))).join(tops, "top", "left_semi").select("page_id", "path")


@query("documents", sql="SELECT doc_id FROM documents WHERE source <> 'src3' AND length(text) <= 1200 AND len(list_filter(string_split(source || '/' || lang, '/'), lambda z: regexp_full_match(z, '[a-z0-9]+'))) = 2")
def shareable_versions(documents: DataFrame) -> DataFrame:
    zones = F.split(F.concat_ws("/", "source", "lang"), "/", -1)
    valid = F.forall(zones, lambda z: z.rlike("^[a-z0-9]+$")) & (F.size(zones) <= 8) & F.col("lang").isNotNull()
    return documents.filter((F.col("source") != "src3") & (F.length("text") <= 1200) & valid).select("doc_id")


_TURNS = "w AS (SELECT user_id, event_id, ts AS begins, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ends FROM events WHERE event_type = 'view')"


@query("events", sql=f"WITH {_TURNS} SELECT w.event_id AS turn, e.event_id AS item FROM w JOIN events e ON e.user_id = w.user_id AND e.event_type = 'click' AND e.ts >= w.begins AND (w.ends IS NULL OR e.ts < w.ends)")
def injections_in_turns(events: DataFrame) -> DataFrame:
    """What falls into each half-open window of the same session; the last window has no end."""
    mine = W.partitionBy("user_id").orderBy("ts", "event_id")
    turns = events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("turn"), F.col("ts").alias("begins"), F.lead("ts").over(mine).alias("ends"))
    items = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("item"), "ts")
    inside = (F.col("ts") >= F.col("begins")) & (F.col("ends").isNull() | (F.col("ts") < F.col("ends")))
    return turns.join(items, "user_id").filter(inside).select("turn", "item")


@query("orders", sql="WITH r AS (SELECT src, dst FROM (SELECT o_orderkey AS src, o_orderkey * 2 AS dst FROM orders UNION SELECT o_orderkey, o_orderkey // 3 FROM orders) WHERE dst IN (SELECT o_orderkey FROM orders)) SELECT a, b FROM (SELECT src AS a, dst AS b FROM r UNION SELECT dst, src FROM r) WHERE a <> b")
def links_both_ways(orders: DataFrame) -> DataFrame:
    links = order_relations(orders).toDF("a", "b")
    return selection.both_ways(links, orders.select(F.col("o_orderkey").alias("idx")))


@query("events", sql="SELECT user_id, count(*) FILTER (event_type IN ('view', 'click') AND CAST(json_extract_string(props, '$.k') AS BIGINT) < 50) AS items, count(*) FILTER (event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS BIGINT) < 50) AS used, count(*) AS events, max(ts) AS last FROM events GROUP BY 1")
def memory_items(events: DataFrame) -> DataFrame:
    """Of each session what counts among items of one family, its events, and when it was last active."""
    family = F.get_json_object("props", "$.k").cast("long") < 50
    return events.groupBy("user_id").agg(F.count_if(family & F.col("event_type").isin("view", "click")).alias("items"), F.count_if(family & (F.col("event_type") == "click")).alias("used"), F.count("*").alias("events"), F.max("ts").alias("last"))


@query("orders", sql="SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS anchors FROM orders GROUP BY 1")
def anchors_per_key(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("anchors"))


@query("embeddings", sql="WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings), s AS (SELECT label, pos, sum(CAST(v AS DOUBLE)) AS s FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(s * s)) AS n FROM s GROUP BY 1) SELECT label, pos, round(s / n, 6) AS part FROM s JOIN n USING (label)")
def summed_unit_vectors(embeddings: DataFrame) -> DataFrame:
    """The vectors of a label added up and brought to length 1."""
    cells = embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    sums = cells.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.sum(F.col("v").cast("double")).alias("s"))
    norms = sums.groupBy("label").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("n"))
    return sums.join(norms, "label").select("label", "pos", F.round(F.col("s") / F.col("n"), 6).alias("part"))


@query("pages", sql="WITH r AS (SELECT regexp_extract(url, 'example\\.([a-z]+)', 1) AS framework, page_id, count(*) OVER (PARTITION BY framework) AS every, row_number() OVER (PARTITION BY framework ORDER BY page_id) AS k FROM pages) SELECT framework, page_id, every - 8 AS more FROM r WHERE k <= 8".replace("\\\\", "\\"))
def routes_by_framework(pages: DataFrame) -> DataFrame:
    """The first eight of each kind, and how many more there are."""
    kind = W.partitionBy("framework")
    rows = pages.select(F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("framework"), "page_id").withColumns({"every": F.count("*").over(kind), "k": F.row_number().over(kind.orderBy("page_id"))})
    return rows.filter("k <= 8").select("framework", "page_id", (F.col("every") - 8).alias("more"))


@query("lineitem", sql="WITH c AS (SELECT l_orderkey, l_linenumber, lag(l_linenumber, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM lineitem) SELECT l_orderkey, count(*) FILTER (l_linenumber <> before + 1) AS breaks, max(l_linenumber) AS head FROM c GROUP BY 1")
def chain_breaks(lineitem: DataFrame) -> DataFrame:
    """Versions that don't follow the one before by one: gaps, and numbers that come twice."""
    before = F.lag("l_linenumber", 1, 0).over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    rows = lineitem.select("l_orderkey", "l_linenumber", before.alias("before"))
    return rows.groupBy("l_orderkey").agg(F.count_if(F.col("l_linenumber") != F.col("before") + 1).alias("breaks"), F.max("l_linenumber").alias("head"))


@query("events", sql="WITH f AS (SELECT event_type, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS three, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter, round(percent_rank() OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS share FROM events) SELECT event_type, quarter, count(*) AS n, round(sum(three), 4) AS three, CAST(sum(day) AS BIGINT) AS day, round(sum(share), 4) AS share, round(quantile_cont(three, 0.5), 5) AS p50, round(quantile_cont(three, 0.95), 5) AS p95 FROM f GROUP BY 1, 2")
def window_frames(events: DataFrame) -> DataFrame:
    """Frames by rows and by time, quarters, percent ranks, and percentiles of what the frames give."""
    mine = W.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    rows = events.withColumn("second", second).select("event_type", F.round(F.sum("value").over(mine.rowsBetween(-2, 0)), 6).alias("three"), F.count("*").over(W.partitionBy("user_id").orderBy("second").rangeBetween(-86400, 0)).alias("day"), F.ntile(4).over(mine).alias("quarter"), F.round(F.percent_rank().over(mine), 6).alias("share"))
    return rows.groupBy("event_type", F.col("quarter").cast("long").alias("quarter")).agg(F.count("*").alias("n"), F.round(F.sum("three"), 4).alias("three"), F.sum("day").alias("day"), F.round(F.sum("share"), 4).alias("share"), F.round(F.percentile("three", 0.5), 5).alias("p50"), F.round(F.percentile("three", 0.95), 5).alias("p95"))


@query("documents", sql="SELECT doc_id, n_chars, 30 AS next_offset, count(*) OVER () AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 20")
def offset_page(documents: DataFrame) -> DataFrame:
    """Ten rows from the twentieth on, where the next page begins, and how many rows there are."""
    total = documents.agg(F.count("*").alias("total"))
    page = documents.orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(10)
    return page.crossJoin(F.broadcast(total)).select("doc_id", "n_chars", F.lit(30).alias("next_offset"), "total")


@query("documents", sql="WITH s AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS h FROM documents) SELECT CASE WHEN s.doc_id IS NULL THEN 'added' WHEN s.h IS NOT DISTINCT FROM n.h THEN 'skipped' ELSE 'conflict' END AS outcome, count(*) AS n, min(n.doc_id) AS first FROM n LEFT JOIN s USING (doc_id) GROUP BY 1")
def idempotent_append(documents: DataFrame) -> DataFrame:
    """Records that come again are skipped if they are equal, and a conflict if not; others are added."""
    store = documents.filter("doc_id % 3 <> 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("old"), F.lit(True).alias("known"))
    said = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows = documents.select("doc_id", F.md5(said.cast("binary")).alias("new")).join(store, "doc_id", "left")
    outcome = F.when(F.col("known").isNull(), "added").when(F.col("old").eqNullSafe(F.col("new")), "skipped").otherwise("conflict")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("orders", "lineitem", sql="SELECT 'interval' AS problem, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT 'state', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'kind', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') UNION ALL SELECT 'version', count(*) FROM lineitem WHERE l_linenumber < 1")
def interval_and_enum_checks(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """How many records have an end before their beginning, an unknown state or kind, or a version below one."""
    count = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    dated = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(orders.select("o_orderkey", "o_orderdate"), "o_orderkey")
    checks = {"interval": dated.filter("l_shipdate < o_orderdate"), "state": orders.filter(~F.col("o_orderstatus").isin(STATES[:2])), "kind": orders.filter(~F.col("o_orderpriority").isin(PRIORITIES)), "version": lineitem.filter("l_linenumber < 1")}
    out = None
    for name, rows in checks.items():
        out = count(rows, name) if out is None else out.union(count(rows, name))
    return out


@query("orders", sql="WITH r AS (SELECT src, dst FROM (SELECT o_orderkey AS src, o_orderkey * 2 AS dst FROM orders UNION SELECT o_orderkey, o_orderkey // 3 FROM orders) WHERE dst IN (SELECT o_orderkey FROM orders)) SELECT r.src, r.dst FROM r JOIN orders a ON a.o_orderkey = r.src JOIN orders b ON b.o_orderkey = r.dst WHERE greatest(a.o_orderdate, b.o_orderdate) <= TIMESTAMP '1996-07-01' AND a.o_orderdate + INTERVAL 900 DAY > TIMESTAMP '1996-07-01'")
def edges_visible_at(orders: DataFrame) -> DataFrame:
    """Edges whose ends were both recorded by a time and that are in force at it."""
    at, day = F.lit("1996-07-01").cast("timestamp_ntz"), orders.select("o_orderkey", "o_orderdate")
    rows = order_relations(orders).join(day.toDF("src", "a"), "src").join(day.toDF("dst", "b"), "dst")
    return rows.filter((F.greatest("a", "b") <= at) & (F.col("a") + F.expr("interval 900 days") > at)).select("src", "dst")


@query("lineitem", sql=f"WITH e AS ({_EDGES}), l1 AS (SELECT DISTINCT dst AS node FROM e WHERE src = 's1'), l2 AS (SELECT DISTINCT dst AS node FROM e JOIN l1 ON src = node WHERE dst <> 's1' AND dst NOT IN (SELECT node FROM l1)), a AS (SELECT node, CAST(1 AS BIGINT) AS depth FROM l1 UNION ALL SELECT node, 2 FROM l2) SELECT depth, count(*) AS files, min(node) AS first, max(node) AS last, CAST(sum(count(*)) OVER () AS BIGINT) AS transitive FROM a GROUP BY depth")
def impact_layers(lineitem: DataFrame) -> DataFrame:
    """How many nodes each step reaches, and all steps together."""
    start = lineitem.sparkSession.createDataFrame([("s1",)], "node string")
    layers = graph.reach(edges(lineitem), start, 2).filter("depth > 0").groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("files"), F.min("node").alias("first"), F.max("node").alias("last"))
    return layers.withColumn("transitive", F.sum("files").over(W.partitionBy()))  # two rows


@query("lineitem", sql="WITH s AS (SELECT l_suppkey, l_returnflag = 'R' AS new, l_partkey FROM lineitem GROUP BY ALL), n AS (SELECT l_suppkey, count(*) FILTER (NOT new) AS a, count(*) FILTER (new) AS b FROM s GROUP BY 1), i AS (SELECT x.l_suppkey, count(*) AS shared FROM s x JOIN s y ON x.l_suppkey = y.l_suppkey AND x.l_partkey = y.l_partkey AND NOT x.new AND y.new GROUP BY 1) SELECT l_suppkey, CASE WHEN a = 0 THEN 'missing' WHEN b = 0 THEN 'unknown' WHEN coalesce(shared, 0) = a + b - coalesce(shared, 0) THEN 'unchanged' ELSE 'changed' END AS state, round(least(coalesce(shared, 0) / (a + b - coalesce(shared, 0)), least(a, b) / greatest(a, b)), 6) AS similarity FROM n LEFT JOIN i USING (l_suppkey)")
def shape_drift(lineitem: DataFrame) -> DataFrame:
    """Parts of a supplier before and now: the lower of what they share and of their sizes' ratio, and what that makes of it."""
    parts = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") != "R").alias("old"), F.bool_or(F.col("l_returnflag") == "R").alias("new"))
    n = parts.groupBy("l_suppkey").agg(F.count_if("old").alias("a"), F.count_if("new").alias("b"), F.count_if(F.col("old") & F.col("new")).alias("both"))
    union = F.col("a") + F.col("b") - F.col("both")
    state = F.when(F.col("a") == 0, "missing").when(F.col("b") == 0, "unknown").when(F.col("both") == union, "unchanged").otherwise("changed")
    return n.select("l_suppkey", state.alias("state"), F.round(F.least(F.col("both") / union, F.least("a", "b") / F.greatest("a", "b")), 6).alias("similarity"))


@query("embeddings", sql="WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) DESC, vec_id) - 1 AS i FROM embeddings, q) SELECT id, round(greatest(0, 1 - CAST(0.05 AS DOUBLE) * i), 6) AS relevance FROM r WHERE i < 30")
def relevance_decay(embeddings: DataFrame) -> DataFrame:
    """What is ranked loses a twentieth with each place."""
    from .ranking import _cosines

    best = _cosines(embeddings).orderBy(F.desc("s"), "id").limit(30)
    place = F.row_number().over(W.orderBy(F.desc("s"), "id")) - 1  # of thirty rows
    return best.select("id", F.round(F.greatest(F.lit(0.0), 1 - 0.05 * place), 6).alias("relevance"))


@query("part", sql="WITH r AS (SELECT p_brand, p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey, k, n - 3 AS more FROM r WHERE k <= 3")
def top_per_category(part: DataFrame) -> DataFrame:
    by = W.partitionBy("p_brand")
    rows = part.select("p_brand", "p_partkey", F.row_number().over(by.orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long").alias("k"), (F.count("*").over(by) - 3).alias("more"))
    return rows.filter("k <= 3")


_CALLED = "[p_type || '/app/' || replace(p_name, ' ', '/[') || ']/page.tsx', 'src/' || p_brand || '.ts', 'pages/' || replace(p_name, ' ', '/') || '/index.js'][CAST(p_partkey % 3 AS INTEGER) + 1]"


@query("part", sql=f"WITH f AS (SELECT p_partkey, {_CALLED} AS file FROM part), m AS (SELECT *, regexp_extract(file, '(^|/)(pages|app)/(.+?)/?(route|page|index)?\\.(ts|tsx|js|jsx)$', 3) AS inner_path FROM f) SELECT p_partkey, file, CASE WHEN inner_path <> '' THEN '/' || regexp_replace(regexp_replace(inner_path, '\\[(\\w+)\\]', ':\\1', 'g'), '/index$', '') END AS route FROM m".replace("\\\\", "\\"))
def file_routes(part: DataFrame) -> DataFrame:
    """Routes that files serve by their place, parameters in brackets."""
    name = lambda put: F.replace("p_name", F.lit(" "), F.lit(put))
    file = F.element_at(F.array(F.concat("p_type", F.lit("/app/"), name("/["), F.lit("]/page.tsx")), F.concat(F.lit("src/"), "p_brand", F.lit(".ts")), F.concat(F.lit("pages/"), name("/"), F.lit("/index.js"))), (F.col("p_partkey") % 3).cast("int") + 1)
    return part.select("p_partkey", file.alias("file")).withColumn("route", paths.file_route(F.col("file")))


_ADDRESS = "['https://user@www.' || host || ':8443/team/' || page_id || '.git?x=1', 'git@' || host || ':team//a_' || page_id || '.git/', 'ssh://git@' || host || '/_git/x/' || page_id || '#top', '/local/' || page_id][CAST(page_id % 4 AS INTEGER) + 1]"
_REMOTE = "lower(trim(address))"
for _pattern, _put in ((r"[?#].*$", ""), (r"^[a-z][a-z0-9+.-]*://", ""), (r"^[^@/]+@", ""), (r"^([^/:]+):[0-9]+(/|$)", r"\1\2"), (r"^([^/:]+):/?", r"\1/"), (r"^www\.", ""), (r"^ssh\.dev\.azure\.com/v3/", "dev.azure.com/"), (r"/_git/", "/"), (r"/{2,}", "/"), (r"/+$", ""), (r"\.git$", ""), (r"/+$", "")):
    _REMOTE = f"regexp_replace({_REMOTE}, '{_pattern}', '{_put}'{', ' + repr('g') if _pattern == '/{2,}' else ''})"


@query("pages", sql=rf"WITH h AS (SELECT page_id, {_ZONE} AS host FROM pages), a AS (SELECT page_id, {_ADDRESS} AS address FROM h), r AS (SELECT *, {_REMOTE} AS remote FROM a) SELECT page_id, CASE WHEN regexp_matches(remote, '^([a-z0-9-]+(\.[a-z0-9-]+)+|localhost)(/[^/\s]+){{2,}}$') THEN remote END AS remote, regexp_replace(regexp_extract(address, '[:/]([^/:]+/[^/]+?)(\.git)?$', 1), '[^a-zA-Z0-9._-]+', '__', 'g') AS slug FROM r")
def repository_names(pages: DataFrame) -> DataFrame:
    """Addresses of repositories in several spellings, as host and path, and as a name for files."""
    key, host = F.col("page_id").cast("string"), F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    spelled = [F.concat(F.lit("https://user@www."), host, F.lit(":8443/team/"), key, F.lit(".git?x=1")), F.concat(F.lit("git@"), host, F.lit(":team//a_"), key, F.lit(".git/")), F.concat(F.lit("ssh://git@"), host, F.lit("/_git/x/"), key, F.lit("#top")), F.concat(F.lit("/local/"), key)]
    rows = pages.select("page_id", F.element_at(F.array(*spelled), (F.col("page_id") % 4).cast("int") + 1).alias("address"))
    return rows.select("page_id", paths.remote_name(F.col("address")).alias("remote"), paths.repository_slug(F.col("address")).alias("slug"))


@query("documents", sql=r"SELECT doc_id, sha1(array_to_string([source, lang, CAST(doc_id AS VARCHAR)], chr(10)) || chr(10)) AS list_hash, CASE WHEN doc_id % 2 = 0 THEN substr(sha256(text), 1, 8) ELSE 'version:' || substr(sha256(text), 1, 9) END AS reference, nullif(substr(trim(regexp_replace(regexp_replace(substr(text, 1, 200), '[\x00-\x1f\x7f\"]+', ' ', 'g'), '[\t\n\v\f\r\pZ\x{FEFF}]+', ' ', 'g')), 1, 80), '') AS name FROM documents WHERE text IS NOT NULL")
def names_and_references(documents: DataFrame) -> DataFrame:
    """Hashes of lists, short references to versions, names to show."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    version = F.concat(F.lit("version:"), F.when(F.col("doc_id") % 2 == 0, digest).otherwise(F.substring(digest, 1, 9)))
    return documents.filter("text is not null").select("doc_id", text.list_hash(F.array("source", "lang", F.col("doc_id").cast("string"))).alias("list_hash"), text.short_reference(version).alias("reference"), text.clean_name(F.substring("text", 1, 200)).alias("name"))


@query("orders", sql=r"WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y-02-30T10:00:00Z') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS said FROM orders) SELECT o_orderkey, regexp_full_match(said, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z') AND TRY_CAST(substr(said, 1, 10) AS DATE) IS NOT NULL AS instant, TRY_CAST(CASE WHEN regexp_full_match(said, '\d{4}-\d{2}-\d{2}') THEN said END AS DATE) + 1 AS ends FROM s")
def instants_and_days(orders: DataFrame) -> DataFrame:
    """Which texts are instants, and of a day the midnight at which it ends."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy'-02-30T10:00:00Z'")).when(F.col("o_orderkey") % 4 == 2, day).otherwise(F.lit("soon"))
    rows = orders.select("o_orderkey", said.alias("said"))
    ends = F.date_add(F.try_to_date(F.when(F.col("said").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("said")), "yyyy-MM-dd"), 1)
    return rows.select("o_orderkey", text.is_instant(F.col("said")).alias("instant"), ends.alias("ends"))


@query("events", sql="WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, array_to_string(list_sort(list(event_type)), ',') AS kinds, coalesce(max(n) FILTER (event_type = 'click'), 0) AS clicks, CAST(max(n) AS BIGINT) AS most, bool_or(event_type = 'error') AS failed FROM k GROUP BY 1")
def map_functions(events: DataFrame) -> DataFrame:
    """Counts by kind as a map: its keys, one entry, its values."""
    kinds = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return kinds.select("user_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"), F.array_max(F.map_values("m")).alias("most"), F.map_contains_key("m", "error").alias("failed"))


@query("events", sql="""SELECT event_id, '{"event":"' || event_type || '","props":' || replace(props, ' ', '') || ',"user":' || user_id || '}' AS document, list_contains(CAST(json('["view", "click"]') AS VARCHAR[]), event_type) AS listed FROM events""")
def canonical_documents(events: DataFrame) -> DataFrame:
    """Documents with keys in order at every level, however they were written, and membership in a JSON list."""
    written = F.concat(F.lit('{"user": '), "user_id", F.lit(', "props": '), "props", F.lit(', "event": "'), "event_type", F.lit('"}'))
    listed = F.array_contains(F.from_json(F.lit('["view", "click"]'), "array<string>"), F.col("event_type"))
    return events.select("event_id", text.canonical_json(written).alias("document"), listed.alias("listed"))


_HEAD = "CASE p_partkey % 3 WHEN 0 THEN 'export function ' || replace(p_name, ' ', '_') || '(a,' || chr(10) || '  b) {' || chr(10) || '  x' WHEN 1 THEN 'async def ' || replace(p_name, ' ', '_') || '(a,' || chr(10) || '    b):' || chr(10) || '    pass' ELSE 'export const ' || replace(p_name, ' ', '_') || ' = (a) => a' END"


@query("part", sql="SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'function ' || replace(p_name, ' ', '_') || '(a, b)' WHEN 1 THEN 'async def ' || replace(p_name, ' ', '_') || '(a, b)' ELSE 'const ' || replace(p_name, ' ', '_') || ' = (a)' END AS signature, CASE WHEN p_partkey % 4 <= 1 THEN './' ELSE repeat('../', CAST(p_partkey % 4 AS INTEGER) - 1) END || replace(p_name, ' ', '/') AS module FROM part")
def signatures(part: DataFrame) -> DataFrame:
    """Heads of functions over several lines, and modules named from a folder."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("export function "), name, F.lit("(a,\n  b) {\n  x"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("async def "), name, F.lit("(a,\n    b):\n    pass"))).otherwise(F.concat(F.lit("export const "), name, F.lit(" = (a) => a")))
    return part.select("p_partkey", paths.signature(code, F.lit(1)).alias("signature"), paths.relative_module((F.col("p_partkey") % 4).cast("int"), F.replace("p_name", F.lit(" "), F.lit("."))).alias("module"))


@query("part", sql="SELECT p_partkey, array_to_string(list_concat(['src'], list_filter(string_split(lower(p_type), ' '), lambda w: w <> ''), string_split(p_name, ' '), ['get'], string_split(p_name, ' ')), ' ') AS words FROM part WHERE regexp_full_match(p_name, '[a-z]{2,}( [a-z]{2,})*') AND regexp_full_match(p_type, '[A-Z]{2,}')")
def words_of_modules(part: DataFrame) -> DataFrame:
    """Words of a module's path, exports and symbols."""
    whole = part.filter(F.col("p_name").rlike("^[a-z]{2,}( [a-z]{2,})*$") & F.col("p_type").rlike("^[A-Z]{2,}$"))
    path = F.concat(F.lit("src/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".ts"))
    symbol = F.array_join(F.transform(F.split("p_name", " "), F.initcap), "")
    return whole.select("p_partkey", F.array_join(text.module_words(path, F.array(F.concat(F.lit("get"), symbol)), F.array().cast("array<string>")), " ").alias("words"))


@query("conversations", sql="WITH t AS (SELECT conv_id, turn, lower(regexp_replace(trim(regexp_replace(substr(text, 1, 1 + turn % 3), '\\s+', ' ', 'g')), '[.!;:, ]+$', '')) AS said FROM conversations WHERE text IS NOT NULL) SELECT a.conv_id, a.turn FROM t a WHERE EXISTS (SELECT 1 FROM t b WHERE b.conv_id = a.conv_id AND b.turn <> a.turn AND contains(b.said, a.said) AND (length(b.said) > length(a.said) OR b.turn < a.turn))".replace("\\\\", "\\"))
def contained_quotes(conversations: DataFrame) -> DataFrame:
    """Quotes that a fuller one of the same session holds, or an equal one before: the fuller one replaces them. Quotes are the
    first characters of a turn here, so that some hold others."""
    quote = F.substring(F.col("text"), F.lit(1), (1 + F.col("turn") % 3).cast("int"))
    t = conversations.filter("text is not null").select("conv_id", "turn", text.normalised(quote).alias("said"))
    other = t.select("conv_id", F.col("turn").alias("o"), F.col("said").alias("full"))
    fuller = (t.conv_id == other.conv_id) & (t.turn != F.col("o")) & F.contains(F.col("full"), t.said) & ((F.length("full") > F.length(t.said)) | (F.col("o") < t.turn))
    return t.join(other, fuller, "left_semi").select("conv_id", "turn")


@query("conversations", sql="SELECT conv_id, turn, role, '' AS content, CAST(NULL AS VARCHAR) AS actor, length(text) AS size FROM conversations WHERE role IN ('user', 'assistant')")
def minimal_payload(conversations: DataFrame) -> DataFrame:
    """What a scoring service gets: who and when, no words."""
    return conversations.filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", F.lit("").alias("content"), F.lit(None).cast("string").alias("actor"), F.length("text").cast("long").alias("size"))


@query("events", sql="WITH d AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view'), p AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'view') SELECT user_id, k FROM p ANTI JOIN d USING (user_id, k)")
def undelivered(events: DataFrame) -> DataFrame:
    """What a session has not been given yet."""
    rows = events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_type") == "view").alias("given"))
    return rows.filter("not given").select("user_id", "k").distinct().join(rows.filter("given").select("user_id", "k"), ["user_id", "k"], "left_anti")
