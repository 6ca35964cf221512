"""Queries of the dependency graph over declarations and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremill.operators import graph
from theoremill.plans.retrieval import decl_sql, declarations
from theoremill.runtime import read_table, strip

ROOT = 300


def _edges(spark: SparkSession, sf: str, relation: str = "uses") -> DataFrame:
    rows = read_table(spark, sf, "dependencies").filter(F.lower(strip("relation")) == relation)
    return graph.clean_edges(rows)


def _root(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ROOT,)], "node long")


def closure_depth3(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(_edges(spark, sf), _root(spark), 3)


def impact_depth3(spark: SparkSession, sf: str) -> DataFrame:
    return graph.impact(_edges(spark, sf), _root(spark), depth=3)


def scoped_closure(spark: SparkSession, sf: str) -> DataFrame:
    inside = declarations(spark, sf).filter(graph.scope(excluded="Sundry.")).select(F.col("id").alias("node"))
    return graph.closure(_edges(spark, sf), _root(spark), 3, inside)


def detect_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of the instance_of rows only, as its SQL has it; :func:`detect_cycles_uses` has those of the dependency graph."""
    return graph.components(_edges(spark, sf, "instance_of"))


def detect_cycles_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of the dependency graph. SQL can't do mutual reachability on the whole table, so it has no oracle."""
    return graph.components(_edges(spark, sf))


def module_summary(spark: SparkSession, sf: str) -> DataFrame:
    nodes = declarations(spark, sf).select(F.col("id").alias("node"), "module")
    return graph.module_summary(_edges(spark, sf), nodes)


def dependency_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.subgraph(_edges(spark, sf), _root(spark))


def get_lemma(spark: SparkSession, sf: str) -> DataFrame:
    """Names a declaration uses and names of those that use it."""
    rows, edges = declarations(spark, sf).select("id", "name"), _edges(spark, sf)
    uses = edges.filter(F.col("src") == ROOT).join(rows, F.col("dst") == F.col("id")).select(F.lit("uses").alias("direction"), "name")
    used = edges.filter(F.col("dst") == ROOT).join(rows, F.col("src") == F.col("id")).select(F.lit("used_by").alias("direction"), "name")
    return uses.unionByName(used)


def related_same_module(spark: SparkSession, sf: str) -> DataFrame:
    rows = declarations(spark, sf).select("id", "name", "module")
    own = rows.filter(F.col("id") == ROOT).select(F.col("id").alias("own"), "module")
    return rows.join(F.broadcast(own), "module").filter("id <> own").select("id", "name")  # one row


def related_same_typeclass(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of declaration and class for declarations that are instances of a class another one is of."""
    edges = _edges(spark, sf, "instance_of")
    several = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return edges.join(several, "dst").select(F.col("src").alias("id"), F.col("dst").alias("class"), (F.col("n") - 1).alias("others"))


def lookup_ids(spark: SparkSession, sf: str) -> DataFrame:
    return declarations(spark, sf).filter(F.col("id").isin(101, 205, 333, 999_999_999)).select("id", "name", "kind")


QUERIES = {
    f.__name__: f
    for f in (closure_depth3, impact_depth3, scoped_closure, detect_cycles, detect_cycles_uses, module_summary, dependency_subgraph, get_lemma, related_same_module, related_same_typeclass, lookup_ids)
}


def _edge_sql(relation: str = "uses") -> str:
    return f"e AS (SELECT DISTINCT src, dst FROM dependencies WHERE lower(trim(relation, chr(32) || chr(9) || chr(10) || chr(13))) = '{relation}' AND dst IS NOT NULL AND src <> dst)"


def _closure_sql(src: str, dst: str, depth: int, where: str = "") -> str:
    return f"c AS (SELECT CAST({ROOT} AS BIGINT) AS node, 0 AS depth UNION SELECT e.{dst}, c.depth + 1 FROM c JOIN e ON e.{src} = c.node WHERE c.depth < {depth} {where})"


ORACLES = {
    "closure_depth3": f"WITH RECURSIVE {_edge_sql()}, {_closure_sql('src', 'dst', 3)} SELECT node, min(depth) AS depth FROM c GROUP BY node",
    "impact_depth3": f"WITH RECURSIVE {_edge_sql()}, {_closure_sql('dst', 'src', 3)} SELECT node, min(depth) AS depth FROM c GROUP BY node",
    "scoped_closure": f"WITH RECURSIVE {decl_sql()}, ok AS (SELECT id FROM d WHERE module IS NULL OR NOT starts_with(module, 'Sundry.')), {_edge_sql()}, {_closure_sql('src', 'dst', 3, 'AND e.dst IN (SELECT id FROM ok)')} SELECT node, min(depth) AS depth FROM c GROUP BY node",
    "detect_cycles": f"WITH RECURSIVE {_edge_sql('instance_of')}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a",
    "module_summary": f"WITH {decl_sql()}, {_edge_sql()}, p AS (SELECT DISTINCT a.module AS s, b.module AS t FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst WHERE a.module <> b.module) SELECT module, (SELECT count(*) FROM p WHERE t = module) AS fan_in, (SELECT count(*) FROM p WHERE s = module) AS fan_out, count(*) AS nodes FROM d GROUP BY module",
    "dependency_subgraph": f"WITH RECURSIVE {_edge_sql()}, {_closure_sql('src', 'dst', 2)} SELECT node, min(depth) AS depth FROM c GROUP BY node ORDER BY 2, 1 LIMIT 50",
    "get_lemma": f"WITH {decl_sql()}, {_edge_sql()} SELECT 'uses' AS direction, name FROM e JOIN d ON d.id = dst WHERE src = {ROOT} UNION ALL SELECT 'used_by', name FROM e JOIN d ON d.id = src WHERE dst = {ROOT}",
    "related_same_module": f"WITH {decl_sql()} SELECT id, name FROM d WHERE module = (SELECT module FROM d WHERE id = {ROOT}) AND id <> {ROOT}",
    "related_same_typeclass": f"WITH {_edge_sql('instance_of')} SELECT src AS id, dst AS class, n - 1 AS others FROM e JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst HAVING count(*) > 1) USING (dst)",
    "lookup_ids": f"WITH {decl_sql()} SELECT id, name, kind FROM d WHERE id IN (101, 205, 333, 999999999)",
}
