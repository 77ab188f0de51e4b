"""Queries over graphs: traversal, symbol edges, relations, data flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxspark.operators import graph
from ctxspark.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _edges(spark, d):
    """Regions to nations, nations to customers, customers to orders, as one graph of strings."""
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    return n.unionByName(c).unionByName(o)


_E = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def _bfs_sql(depth: int, start: str, a: str = "src", b: str = "dst") -> str:
    steps = ["s0 AS (SELECT DISTINCT node, 0 AS depth FROM (" + start + "))"]
    for n in range(1, depth + 1):
        steps.append(f"s{n} AS (SELECT * FROM s{n - 1} UNION ALL SELECT DISTINCT {b}, {n} FROM s{n - 1} JOIN e ON node = {a} AND depth = {n - 1} WHERE {b} NOT IN (SELECT node FROM s{n - 1}))")
    return f"WITH {_E}, {', '.join(steps)} SELECT node, depth FROM s{depth} WHERE depth > 0"


def _start(spark, d):
    return table(spark, d, "nation").where("n_nationkey < 5").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))


_START = "SELECT 'n' || n_nationkey AS node FROM nation WHERE n_nationkey < 5"


@R.query(_bfs_sql(1, _START))
def bfs_dependencies_1(spark, d):
    return graph.dependencies(_edges(spark, d), _start(spark, d), 1)


@R.query(_bfs_sql(2, _START))
def bfs_dependencies_2(spark, d):
    return graph.dependencies(_edges(spark, d), _start(spark, d), 2)


@R.query(_bfs_sql(2, "SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT'", "dst", "src"))
def bfs_dependents_2(spark, d):
    seeds = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.dependents(_edges(spark, d), seeds, 2)


@R.query("""WITH l AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, l_returnflag AS r FROM lineitem), e AS (SELECT a AS from_id, b AS to_id, r AS relationship FROM l UNION ALL SELECT b, a, 'inverse:' || r FROM l),
s1 AS (SELECT to_id AS id, 1 AS depth, min(relationship) AS relationship FROM e WHERE from_id = 's1' AND to_id <> 's1' GROUP BY to_id),
s2 AS (SELECT to_id AS id, 2 AS depth, min(e.relationship) AS relationship FROM s1 JOIN e ON from_id = id WHERE to_id <> 's1' AND to_id NOT IN (SELECT id FROM s1) GROUP BY to_id)
SELECT * FROM s1 UNION ALL SELECT * FROM s2""")
def bfs_related(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), F.col("l_returnflag").alias("r"))
    links = li.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.col("r").alias("relationship")).unionByName(li.select(F.col("b").alias("from_id"), F.col("a").alias("to_id"), F.concat(F.lit("inverse:"), "r").alias("relationship")))
    return graph.related_recursive(links, spark.createDataFrame([("s1",)], "id string"), 2)


@R.query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS file_id FROM lineitem WHERE l_returnflag <> 'R'), f AS (SELECT file_id, min(id) AS from_symbol_id FROM x GROUP BY file_id),
i AS (SELECT o_orderkey AS file_id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target FROM orders)
SELECT from_symbol_id, x.id AS to_symbol_id, 'imports' AS kind FROM i JOIN f USING (file_id) JOIN x ON x.file_id = target WHERE from_symbol_id <> x.id""")
def edges_representative(spark, d):
    from pyspark.sql import Window as W

    syms = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("file_id"), (F.col("l_returnflag") != "R").alias("exported"))
    nxt = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    imps = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), nxt.alias("resolved_file_id")).where("resolved_file_id IS NOT NULL")
    return graph.representative_edges(imps, syms)


def _flow(spark, d):
    """Parts as tables, orders as queries, customers as files."""
    kind = F.when(F.col("c_custkey") % 3 == 0, "mongo/Client.ts").when(F.col("c_custkey") % 3 == 1, "OrderService.ts").otherwise("other.py")
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("src/"), F.col("c_custkey").cast("string"), F.lit("/"), kind).alias("path"))
    queries = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"))
    tables = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("query_id"), F.col("p_name").alias("table_name")).distinct()
    return files, queries, tables


_FLOW = """g AS (SELECT DISTINCT p_name AS table_name, o_orderkey AS query_id, c_custkey % 3 AS k, 'src/' || c_custkey || '/' || CASE c_custkey % 3 WHEN 0 THEN 'mongo/Client.ts' WHEN 1 THEN 'OrderService.ts' ELSE 'other.py' END AS path
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@R.query(f"WITH {_FLOW}, t AS (SELECT min(p_name) AS t FROM part) SELECT count(DISTINCT path) AS n_files, count(DISTINCT CASE WHEN k = 1 THEN 'OrderService' END) AS n_services, array_to_string(list_sort(list(DISTINCT path)), ',') AS files FROM g, t WHERE table_name = t")
def impact_chain(spark, d):
    first = table(spark, d, "part").agg(F.min("p_name")).first()[0]
    i = graph.impact(graph.projection(*_flow(spark, d)), first)
    return i.select("n_files", "n_services", F.array_join("files", ",").alias("files"))


@R.query(f"WITH {_FLOW} SELECT table_name, array_to_string(list_sort(list(DISTINCT CASE k WHEN 0 THEN 'mongodb' WHEN 1 THEN 'sql' ELSE 'unknown' END)), ',') AS systems FROM g GROUP BY table_name HAVING count(DISTINCT k) > 1")
def parallel_storage(spark, d):
    return graph.parallel_storage(graph.projection(*_flow(spark, d))).select("table_name", F.array_join("systems", ",").alias("systems"))


@R.query("SELECT o_orderkey AS id FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def orphan_queries(spark, d):
    return graph.validate(*_flow(spark, d))["orphan_queries"].select("id")


def _shared(spark, d):
    """Orders as entities, part and supplier as the files that they share."""
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("key"))
    kind = F.when(F.col("o_orderstatus") == "F", "bug_fix").when(F.col("o_orderstatus") == "P", "pattern").otherwise("decision")
    return graph.shared_relations(keys, table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), kind.alias("type")))


_SHARED = """k AS (SELECT DISTINCT l_orderkey AS id, l_partkey, l_suppkey FROM lineitem), r AS (SELECT DISTINCT a.id AS f, b.id AS t FROM k a JOIN k b USING (l_partkey, l_suppkey) WHERE a.id <> b.id),
s AS (SELECT CAST(f AS VARCHAR) AS from_id, CAST(t AS VARCHAR) AS to_id, CASE o_orderstatus WHEN 'F' THEN 'fixes' WHEN 'P' THEN 'implements' ELSE 'relates_to' END AS relationship FROM r JOIN orders ON o_orderkey = f)"""


@R.query(f"WITH {_SHARED} SELECT * FROM s")
def relationships_shared(spark, d):
    return _shared(spark, d).select("from_id", "to_id", "relationship")


@R.query(f"WITH {_SHARED} SELECT * FROM s UNION SELECT to_id, from_id, 'inverse:' || relationship FROM s")
def backlinks_bidirectional(spark, d):
    return graph.both_ways(_shared(spark, d)).select("from_id", "to_id", "relationship")


@R.query(f"WITH {_SHARED}, n AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200) SELECT from_id, to_id, relationship FROM s SEMI JOIN n ON from_id = n.id WHERE to_id IN (SELECT id FROM n)")
def entities_induced(spark, d):
    nodes = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select(F.col("o_orderkey").cast("string").alias("id"))
    return graph.induced(nodes, _shared(spark, d)).select("from_id", "to_id", "relationship")
