"""Queries over the instance_of hierarchies of the dependency table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremill.operators.hierarchy import hierarchy, parent_edges
from theoremill.runtime import read_table


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return parent_edges(read_table(spark, sf, "dependencies"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(_edges(spark, sf)).nodes.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p2_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Path from the root, number of descendants and their interval of pre-order numbers for every node."""
    nodes = hierarchy(_edges(spark, sf), intervals=True, paths=True).nodes
    return nodes.select(
        F.col("node").alias("node_id"),
        F.col("parent").alias("parent_id"),
        F.col("root").alias("root_id"),
        "depth",
        "kind",
        (F.col("size") - 1).alias("descendants"),
        "lo",
        "hi",
        F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"),
    )


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(_edges(spark, sf), intervals=True).descendants()


def p2_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The stored form of paths: the pieces of chains from the root to each node."""
    nodes = hierarchy(_edges(spark, sf), segments=True).nodes.filter("kind = 'tree'")
    piece = F.transform("segments", lambda x: F.concat_ws(":", x["chain"].cast("string"), x["upto"].cast("string")))
    return nodes.select(F.col("node").alias("node_id"), "chain", "pos", F.array_join(piece, "/").alias("segments"))


def p2_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(_edges(spark, sf)).cycles()


_EDGES = """
edges AS (
  SELECT src AS node, dst AS parent FROM (
    SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY extracted_at DESC NULLS LAST, dst) AS r
    FROM dependencies
    WHERE lower(trim(relation, chr(32) || chr(9) || chr(10) || chr(13))) = 'instance_of' AND dst IS NOT NULL AND src <> dst
  ) WHERE r = 1
)"""

_WALK = f"""
WITH RECURSIVE {_EDGES},
nodes AS (SELECT node FROM edges UNION SELECT parent FROM edges),
walk AS (
  SELECT node AS start, node AS pos, [node] AS path, false AS again FROM nodes
  UNION ALL
  SELECT w.start, e.parent, list_append(w.path, e.parent), list_contains(w.path, e.parent)
  FROM walk w JOIN edges e ON e.node = w.pos WHERE NOT w.again
),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path) DESC) AS r FROM walk) WHERE r = 1),
placed AS (
  SELECT start AS node_id,
    CASE WHEN again THEN list_min(path[list_position(path, pos):]) ELSE pos END AS root_id,
    CASE WHEN NOT again THEN len(path) - 1 WHEN list_position(path, pos) = 1 THEN -1 ELSE -2 END AS depth,
    path
  FROM ends
)"""

_PREORDER = f"""{_WALK},
sizes AS (SELECT path[i] AS node, count(*) AS size FROM placed, unnest(generate_series(1, len(path))) AS t(i) WHERE depth >= 0 GROUP BY 1),
sib AS (SELECT e.node, e.parent, size, row_number() OVER (PARTITION BY e.parent ORDER BY size DESC, e.node) AS rk FROM edges e JOIN sizes USING (node)),
lights AS (
  SELECT node, rk, first_value(size) OVER (PARTITION BY parent ORDER BY rk) AS heavy,
    coalesce(sum(CASE WHEN rk > 1 THEN size END) OVER (PARTITION BY parent ORDER BY rk > 1, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS light
  FROM sib
),
before AS (SELECT node, rk, CASE WHEN rk = 1 THEN 0 ELSE heavy + light END AS before FROM lights),
steps AS (SELECT node_id, i, path[i] AS node FROM placed, unnest(generate_series(1, len(path))) AS t(i) WHERE depth >= 0),
lo AS (SELECT node_id, sum(CASE WHEN b.node IS NULL THEN 0 ELSE 1 + before END) AS lo FROM steps LEFT JOIN before b USING (node) GROUP BY node_id),
heads AS (SELECT node_id, i, node, sum(CASE WHEN rk = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY node_id ORDER BY i DESC) AS piece FROM steps LEFT JOIN before USING (node)),
pieces AS (SELECT node_id, piece, arg_max(node, i) AS chain, count(*) - 1 AS upto FROM heads GROUP BY node_id, piece)"""

QUERIES = {f.__name__: f for f in (p2_found, p2_tree, p2_descendants, p2_segments, p2_cycles)}

ORACLES = {
    "p2_found": f"{_WALK} SELECT node_id, root_id, CAST(depth AS BIGINT) AS depth FROM placed",
    "p2_tree": f"""{_PREORDER}
SELECT p.node_id, e.parent AS parent_id, root_id, CAST(depth AS BIGINT) AS depth, CASE depth WHEN -1 THEN 'cycle' WHEN -2 THEN 'into_cycle' ELSE 'tree' END AS kind,
  s.size - 1 AS descendants, CAST(lo AS BIGINT) AS lo, CAST(lo + s.size AS BIGINT) AS hi, CASE WHEN depth >= 0 THEN array_to_string(list_reverse(p.path), '/') END AS path
FROM placed p LEFT JOIN edges e ON e.node = p.node_id LEFT JOIN sizes s ON s.node = p.node_id AND depth >= 0 LEFT JOIN lo ON lo.node_id = p.node_id""",
    "p2_segments": f"""{_PREORDER}
SELECT node_id, arg_max(chain, piece) AS chain, arg_max(upto, piece) AS pos, string_agg(chain || ':' || upto, '/' ORDER BY piece) AS segments FROM pieces GROUP BY node_id""",
    "p2_descendants": f"""{_WALK}
SELECT path[i] AS ancestor, node_id AS descendant, CAST(i - 1 AS BIGINT) AS distance
FROM placed, unnest(generate_series(2, len(path))) AS t(i) WHERE depth >= 0""",
    "p2_cycles": f"""{_WALK}
SELECT root_id AS cycle_id, CAST(sum(CASE WHEN depth = -1 THEN 1 ELSE 0 END) AS BIGINT) AS length,
  CAST(sum(CASE WHEN depth = -2 THEN 1 ELSE 0 END) AS BIGINT) AS leading_in
FROM placed WHERE depth < 0 GROUP BY root_id""",
}
