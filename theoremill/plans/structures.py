"""Queries of structural search: trees of customers, orders and line items, and type expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremill.operators import trees
from theoremill.plans.retrieval import declarations
from theoremill.runtime import cut, read_table

EXPRESSION = "forall n, n <= dorxan_cong n -> corgaldan_assoc n"


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    """Node table: a customer, its orders, their line items (by part, supplier and line, which is unique)."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    items = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    counts = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    top = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    node = lambda *parts: F.concat_ws(":", *[F.lit(p) if p in "COL" else F.col(p).cast("string") for p in parts])
    c = top.select(F.col("o_custkey").alias("tree"), F.lit("C").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("C").alias("tag"), F.lit(0).alias("depth"), F.col("n").alias("children"))
    o = orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("tree"), node("O", "o_orderkey").alias("node"), F.lit("C").alias("parent"), F.lit("O").alias("tag"), F.lit(1).alias("depth"), F.coalesce("n", F.lit(0)).alias("children"))
    i = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("tree"), node("L", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("node"), node("O", "l_orderkey").alias("parent"), F.lit("L").alias("tag"), F.lit(2).alias("depth"), F.lit(0).alias("children"))
    return c.unionByName(o).unionByName(i)


def wl_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return trees.wl_histograms(_trees(spark, sf))


def wl_screen(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _trees(spark, sf)
    histograms = cut(trees.wl_histograms(nodes))
    sizes = cut(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("size")))
    query = sizes.orderBy(F.desc("size"), "tree").first()
    own = histograms.filter(F.col("tree") == query.tree).select("label", "n")
    return trees.wl_screen(histograms, sizes, own, query.size, 50)


def parsed_types(spark: SparkSession, sf: str) -> DataFrame:
    parsed = trees.parse_types(declarations(spark, sf))
    return parsed.select("id", F.size("nodes").alias("nodes"), F.array_max(F.transform("nodes", lambda n: n.depth)).alias("depth"))


def search_by_structure(spark: SparkSession, sf: str) -> DataFrame:
    return trees.search_by_structure(declarations(spark, sf), EXPRESSION)


def search_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return trees.search_by_type(declarations(spark, sf), EXPRESSION)


QUERIES = {f.__name__: f for f in (wl_histogram, wl_screen, parsed_types, search_by_structure, search_by_type)}

_WL = """
o AS (SELECT o_custkey AS tree, 'O:' || o_orderkey AS node, count(l_orderkey) AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey),
i AS (SELECT o_custkey AS tree, 'O:' || o_orderkey AS parent FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
i0 AS (SELECT tree, parent, md5('L_2_0') AS l0, md5(md5('L_2_0')) AS l1, md5(md5(md5('L_2_0'))) AS l2, md5(md5(md5(md5('L_2_0')))) AS l3 FROM i),
p AS (SELECT tree, parent AS node, string_agg(l0, '' ORDER BY l0) AS s0, string_agg(l1, '' ORDER BY l1) AS s1, string_agg(l2, '' ORDER BY l2) AS s2 FROM i0 GROUP BY ALL),
o0 AS (SELECT o.tree, o.node, md5('O_1_' || c) AS l0, coalesce(s0, '') AS s0, coalesce(s1, '') AS s1, coalesce(s2, '') AS s2 FROM o LEFT JOIN p ON p.tree = o.tree AND p.node = o.node),
o3 AS (SELECT tree, node, l0, md5(l0 || s0) AS l1, md5(md5(l0 || s0) || s1) AS l2, md5(md5(md5(l0 || s0) || s1) || s2) AS l3 FROM o0),
c0 AS (SELECT tree, md5('C_0_' || count(*)) AS l0, string_agg(l0, '' ORDER BY l0) AS s0, string_agg(l1, '' ORDER BY l1) AS s1, string_agg(l2, '' ORDER BY l2) AS s2 FROM o3 GROUP BY tree),
c3 AS (SELECT tree, l0, md5(l0 || s0) AS l1, md5(md5(l0 || s0) || s1) AS l2, md5(md5(md5(l0 || s0) || s1) || s2) AS l3 FROM c0),
u AS (SELECT tree, unnest([l0, l1, l2, l3]) AS label FROM i0 UNION ALL SELECT tree, unnest([l0, l1, l2, l3]) FROM o3 UNION ALL SELECT tree, unnest([l0, l1, l2, l3]) FROM c3),
h AS (SELECT tree, label, count(*) AS n FROM u GROUP BY ALL)"""

ORACLES = {
    "wl_histogram": f"WITH {_WL} SELECT * FROM h",
    "wl_screen": f"""WITH {_WL}, z AS (SELECT tree, count(*) // 4 AS size FROM u GROUP BY tree), q AS (SELECT tree, size FROM z ORDER BY size DESC, tree LIMIT 1),
k AS (SELECT z.tree FROM z, q WHERE greatest(q.size, z.size) / greatest(least(q.size, z.size), 1) <= CASE WHEN q.size < 600 THEN 1.2 ELSE 1.8 END),
d AS (SELECT h.tree, sum(h.n * g.n) AS dot FROM h JOIN h g ON g.label = h.label AND g.tree = (SELECT tree FROM q) WHERE h.tree IN (SELECT tree FROM k) GROUP BY h.tree),
m AS (SELECT tree, sqrt(sum(n * n)) AS norm FROM h GROUP BY tree)
SELECT d.tree, round(dot / (m.norm * (SELECT norm FROM m WHERE tree = (SELECT tree FROM q))), 6) AS wl FROM d JOIN m USING (tree) ORDER BY wl DESC, d.tree LIMIT 50""",
}
