"""Store, join, aggregate and set queries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import store
from ..workload import query

AS_OF = "1996-07-01"


@query("documents", sql="SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500")
def scan_project_filter(documents: DataFrame) -> DataFrame:
    return documents.filter("lang = 'en' and n_chars >= 500").select("doc_id", "source", "n_chars")


@query("events", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("orders", sql="SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def heads_latest(orders: DataFrame) -> DataFrame:
    return store.heads(orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("orders", sql=f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate <= TIMESTAMP '{AS_OF}') WHERE r = 1")
def heads_as_of(orders: DataFrame) -> DataFrame:
    rows = store.as_of(orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_orderdate", F.lit(AS_OF).cast("timestamp_ntz"))
    return store.heads(rows, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("orders", sql="SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS version, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def version_numbers(orders: DataFrame) -> DataFrame:
    return store.chain(orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"), "previous")


@query("orders", sql=f"SELECT o_custkey, o_orderkey FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders) WHERE o_orderdate <= TIMESTAMP '{AS_OF}' AND (until IS NULL OR TIMESTAMP '{AS_OF}' < until)")
def valid_at(orders: DataFrame) -> DataFrame:
    at = F.lit(AS_OF).cast("timestamp_ntz")
    rows = orders.withColumn("until", F.lead("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return rows.filter(store.valid_at(F.col("o_orderdate"), F.col("until"), at)).select("o_custkey", "o_orderkey")


@query("orders", "customer", sql="SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join_heads(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "c_name", "c_mktsegment")


@query("documents", "labels", sql="SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.quality <> 1")
def left_join_missing(documents: DataFrame, labels: DataFrame) -> DataFrame:
    joined = documents.select("doc_id").join(labels.withColumn("found", F.lit(True)), "doc_id", "left")
    return joined.filter("found is null or quality <> 1").select("doc_id", "quality")


@query("documents", "labels", sql="SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unlabelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.select("doc_id", "lang").join(labels, "doc_id", "left_anti")


@query("orders", "customer", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_ids(orders: DataFrame, customer: DataFrame) -> DataFrame:
    wanted = customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return orders.select("o_orderkey", "o_custkey", "o_totalprice").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("orders", "customer", sql="SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_orderkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def disjunctive_semi(orders: DataFrame, customer: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_custkey")
    poor = customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    there = customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_orderkey"))
    return store.semi_any(rows, poor, there)


@query("lineitem", "part", "supplier", sql="SELECT DISTINCT p_brand, s_nationkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'")
def double_join_distinct(lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    pairs = lineitem.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return pairs.join(part, pairs.l_partkey == part.p_partkey).join(supplier, pairs.l_suppkey == supplier.s_suppkey).select("p_brand", "s_nationkey").distinct()


@query("orders", "customer", sql="SELECT c_custkey AS id, CAST(max(v) AS BIGINT) AS version FROM (SELECT c_custkey, 1 AS v FROM customer UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def merge_upsert(orders: DataFrame, customer: DataFrame) -> DataFrame:
    old = customer.select(F.col("c_custkey").alias("id"), F.lit(1).cast("long").alias("version"))
    new = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lit(2).cast("long").alias("version")).distinct()
    return store.upsert(old, new, "id", "version")


@query("documents", sql="SELECT source, lang, count(*) AS n FROM (SELECT DISTINCT doc_id, source, lang FROM documents WHERE doc_id % 3 <> 0 UNION SELECT doc_id, source, lang FROM documents WHERE doc_id % 2 = 0) GROUP BY ALL")
def insert_or_ignore(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "source", "lang")
    return store.insert_or_ignore(rows.filter("doc_id % 3 <> 0"), rows.filter("doc_id % 2 = 0"), "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("documents", sql="WITH t AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 3 <> 0) SELECT source, lang, count(*) AS n FROM (SELECT * FROM t UNION ALL SELECT DISTINCT doc_id, source, lang FROM documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id NOT IN (SELECT doc_id FROM t)) GROUP BY ALL")
def insert_or_ignore_all(documents: DataFrame) -> DataFrame:
    """As insert_or_ignore, of two overlapping parts that together hold every document."""
    rows = documents.select("doc_id", "source", "lang")
    return store.insert_or_ignore(rows.filter("doc_id % 3 <> 0"), rows.filter("doc_id % 2 = 0 or doc_id % 3 = 0"), "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("orders", "customer", sql="(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_operations(orders: DataFrame, customer: DataFrame) -> DataFrame:
    keys = lambda status: orders.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    left = customer.select(F.col("c_custkey").alias("k")).exceptAll(keys("O").distinct()).distinct()
    return left.union(keys("P").intersect(customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")))).distinct()


@query("documents", sql="SELECT coalesce(nullif(split_part(source, '/', 1), ''), '(root)') AS domain, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def domain_rollup(documents: DataFrame) -> DataFrame:
    head = F.split_part("source", F.lit("/"), F.lit(1))
    return documents.groupBy(F.coalesce(F.when(head != "", head), F.lit("(root)")).alias("domain")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("events", sql="SELECT count(*) AS n, count(DISTINCT user_id) AS users, max(event_id) AS last FROM events")
def distinct_counts(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("event_id").alias("last"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def topk_sorted(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


@query("orders", "lineitem", sql="SELECT 'order without line' AS problem, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'repeated id', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def integrity_report(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    o, line = orders.select(F.col("o_orderkey").alias("k")), lineitem.select(F.col("l_orderkey").alias("k"))
    count = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    twice = o.groupBy("k").count().filter("count > 1")
    return count(o.join(line, "k", "left_anti"), "order without line").union(count(line.join(o, "k", "left_anti"), "line without order")).union(count(twice, "repeated id"))


@query("orders", sql="SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_day, CAST(o_orderdate AS DATE) + 30 AS until_day, (DATE '1996-07-01' >= CAST(o_orderdate AS DATE) AND DATE '1996-07-01' < CAST(o_orderdate AS DATE) + 30) AS valid FROM orders")
def day_validity(orders: DataFrame) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    at = F.lit(AS_OF).cast("date")
    return orders.select("o_orderkey", day.alias("from_day"), F.date_add(day, 30).alias("until_day"), store.valid_at(day, F.date_add(day, 30), at).alias("valid"))


@query("documents", sql="SELECT doc_id, sha256(text) AS id, substr(sha256(source || ':' || lang), 1, 16) AS short FROM documents WHERE text IS NOT NULL")
def hash_ids(documents: DataFrame) -> DataFrame:
    return documents.filter("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("id"), F.substring(F.sha2(F.concat("source", F.lit(":"), "lang").cast("binary"), 256), 1, 16).alias("short"))


@query("lineitem", sql="SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(lineitem: DataFrame) -> DataFrame:
    return lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("pages", sql=r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '^www\.', ''), '[?#].*$', '') AS remote FROM pages")
def remote_normalise(pages: DataFrame) -> DataFrame:
    out = F.lower("url")
    for pattern in ("^[a-z]+://", r"^www\.", "[?#].*$"):
        out = F.regexp_replace(out, pattern, "")
    return pages.select("page_id", out.alias("remote"))


@query("pages", sql="SELECT page_id, CAST(length(html) AS BIGINT) AS size, CAST(len(regexp_extract_all(html, 'href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs FROM pages")
def html_counts(pages: DataFrame) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return pages.select("page_id", F.length("html").cast("long").alias("size"), count("href=").alias("links"), count("<p[ >]").alias("paragraphs"))


@query("pages", sql="WITH p AS (SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1) AS path FROM pages), x AS (SELECT page_id, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS prefix FROM p, range(1, 40) t(n) WHERE n <= len(string_split(path, '/'))) SELECT prefix, count(DISTINCT page_id) AS pages FROM x GROUP BY 1")
def prefix_join(pages: DataFrame) -> DataFrame:
    path = F.split(F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("?"), F.lit(1)), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.array_join(F.slice(path, F.lit(1), n), "/"))
    return pages.select("page_id", F.explode(ancestors).alias("prefix")).groupBy("prefix").agg(F.countDistinct("page_id").alias("pages"))


@query("conversations", sql="SELECT conv_id, turn, CASE WHEN role = 'user' THEN substr(text, 1, 1200) END AS shown, role <> 'user' AS withheld FROM conversations")
def redact_projection(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.substring("text", 1, 1200)).alias("shown"), (F.col("role") != "user").alias("withheld"))


@query("documents", sql=r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '[email]', 'g'), '[0-9]{12,19}', '[number]', 'g') AS scrubbed FROM documents")
def scrub_secrets(documents: DataFrame) -> DataFrame:
    out = F.regexp_replace("text", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "[email]")
    return documents.select("doc_id", F.regexp_replace(out, "[0-9]{12,19}", "[number]").alias("scrubbed"))


#: Patterns are spelled so that Java and RE2 read them as JavaScript does: its white space, letters' case in ASCII alone.
_GAP = r"\x09-\x0D \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: RE2's boundary of a word is JavaScript's, Java 17's is not: there it is spelled out.
_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_any_case("password"), f"{_any_case('api')}[_-]?{_any_case('key')}", f"{_any_case('access')}[_-]?{_any_case('token')}", _any_case("authorization")])
_SECRETS = [
    (r"-----BEGIN [^-]*PRIVATE KEY-----[\s\S]*?(?:-----END [^-]*PRIVATE KEY-----|\z)", "[REDACTED PRIVATE KEY]"),
    (r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9_]{16,})\b", "[REDACTED TOKEN]"),
    (rf"\b{_any_case('bearer')}[{_GAP}]+[A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]"),
    (rf"""\b({_NAMES})\b["']?[{_GAP}]*[:=][{_GAP}]*["']?[^{_GAP},"'}}]+""", r"\1=[REDACTED]"),
]
#: What a text holds in lower case if the pattern in the same place finds anything in it.
_MARKS = [["-----begin "], ["sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"], ["bearer"], ["password", "apikey", "api_key", "api-key", "accesstoken", "access_token", "access-token", "authorization"]]
_KEPT = 12_000


def _redacted_sql() -> str:
    out, quoted = "text", lambda x: "'" + x.replace("'", "''") + "'"
    for pattern, put in _SECRETS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(put)}, 'g')"
    return out


@query("documents", "conversations", sql=f"WITH t AS (SELECT 'document' AS kind, doc_id AS id, CAST(NULL AS BIGINT) AS turn, text FROM documents UNION ALL SELECT 'conversation', conv_id, turn, text FROM conversations), c AS (SELECT *, {_redacted_sql()} AS cleaned FROM t) SELECT kind, id, turn, substr(cleaned, 1, {_KEPT}) AS text, length(cleaned) > {_KEPT} AS truncated, cleaned <> text AS redacted FROM c")
def redact_secrets(documents: DataFrame, conversations: DataFrame) -> DataFrame:
    """Private keys, tokens, bearer values and assigned passwords replaced in both tables, then the text cut. Characters
    are code points; of a null text, text and flags are null."""
    rows = documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("turn"), "text")
    rows = rows.unionByName(conversations.select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "turn", "text"))
    rows = rows.withColumn("low", F.lower("text")).withColumn("cleaned", F.col("text"))
    for (pattern, put), marks in zip(_SECRETS, _MARKS, strict=True):  # few texts hold a mark, so few meet a pattern
        held = reduce(or_, (F.contains("low", F.lit(m)) for m in marks))
        rows = rows.withColumn("cleaned", F.when(held, F.regexp_replace("cleaned", pattern.replace(r"\b", _WORD_EDGE), put.replace(r"\1", "$1"))).otherwise(F.col("cleaned")))
    return rows.select("kind", "id", "turn", F.substring("cleaned", 1, _KEPT).alias("text"), (F.length("cleaned") > _KEPT).alias("truncated"), (F.col("cleaned") != F.col("text")).alias("redacted"))
