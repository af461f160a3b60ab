"""Queries on the graph supplier <- part <- order <- customer <- nation that the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph
from ..workload import query

_EDGES = "SELECT DISTINCT 'p' || l_partkey AS src, 'o' || l_orderkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem"


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(lineitem: DataFrame) -> DataFrame:
    used = lineitem.select(_key("p", "l_partkey").alias("src"), _key("o", "l_orderkey").alias("dst"))
    made = lineitem.select(_key("s", "l_suppkey").alias("src"), _key("p", "l_partkey").alias("dst"))
    return used.union(made).distinct()


@query("lineitem", sql=f"WITH e AS ({_EDGES}) SELECT dst AS node, count(*) AS importers, min(src) AS first FROM e GROUP BY 1")
def adjacency_reverse(lineitem: DataFrame) -> DataFrame:
    return graph.inverted(edges(lineitem)).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("importers"), F.min("dst").alias("first"))


@query("lineitem", sql=f"WITH e AS ({_EDGES}), d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT node, degree FROM (SELECT * FROM d ORDER BY degree DESC, node LIMIT 10) WHERE degree >= 5")
def degree_god_nodes(lineitem: DataFrame) -> DataFrame:
    return graph.degrees(edges(lineitem)).orderBy(F.desc("degree"), "node").limit(10).filter("degree >= 5")


@query("lineitem", "orders", sql="WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem UNION SELECT DISTINCT 'o' || o_orderkey, 'c' || o_custkey FROM orders), l1 AS (SELECT DISTINCT dst FROM e WHERE src = 's1'), l2 AS (SELECT DISTINCT e.dst FROM e JOIN l1 ON e.src = l1.dst), l3 AS (SELECT DISTINCT e.dst FROM e JOIN l2 ON e.src = l2.dst) SELECT dst AS node, CAST(1 AS BIGINT) AS depth FROM l1 UNION ALL SELECT dst, 2 FROM l2 UNION ALL SELECT dst, 3 FROM l3")
def impact_bfs(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    all_edges = edges(lineitem).union(orders.select(_key("o", "o_orderkey"), _key("c", "o_custkey")).distinct())
    start = lineitem.sparkSession.createDataFrame([("s1",)], "node string")
    return graph.reach(all_edges, start, 4).filter("depth > 0").select("node", F.col("depth").cast("long").alias("depth"))


@query("part", "supplier", sql="SELECT lower(p_name) AS target, count(*) AS n, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS id FROM part GROUP BY 1")
def resolve_target(part: DataFrame, supplier: DataFrame) -> DataFrame:
    return part.groupBy(F.lower("p_name").alias("target")).agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min("p_partkey")).alias("id"))


@query("lineitem", sql="WITH s AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1), n AS (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), i AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_partkey) AS c FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey <= 10) a JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey <= 10) b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2) SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM i JOIN n x ON x.k = a JOIN n y ON y.k = b")
def shape_jaccard(lineitem: DataFrame) -> DataFrame:
    """Pairs among the suppliers up to 10 alone, as the SQL has it; shape_jaccard_all compares all suppliers."""
    return _jaccard(lineitem.filter("l_suppkey <= 10"))


@query("lineitem", sql="WITH r AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem), n AS (SELECT k, count(*) AS n FROM r GROUP BY 1), i AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM r x JOIN r y ON x.p = y.p AND x.k < y.k GROUP BY 1, 2) SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM i JOIN n x ON x.k = a JOIN n y ON y.k = b")
def shape_jaccard_all(lineitem: DataFrame) -> DataFrame:
    """Every pair of suppliers with a common part."""
    return _jaccard(lineitem)


def _jaccard(lineitem: DataFrame) -> DataFrame:
    """Suppliers meet through shared parts, not in all pairs."""
    rows = lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p")).repartition("k").distinct()
    sized = rows.withColumn("n", F.count("*").over(W.partitionBy("k")).cast("int")).filter("k is not null and p is not null")
    shared = graph.met(sized, lineitem.schema["l_suppkey"].dataType.simpleString())
    return shared.select("a", "b", F.round(F.col("c") / (F.col("x") + F.col("y") - F.col("c")), 6).alias("jaccard"))
