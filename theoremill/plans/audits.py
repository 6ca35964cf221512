"""Queries of set comparison, version ranges, snapshots and merging over declarations and supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremill.operators import audits
from theoremill.plans.retrieval import decl_sql, declarations
from theoremill.runtime import read_table, strip

COMPARED = (101, 102, 103)


def _uses(spark: SparkSession, sf: str) -> DataFrame:
    return declarations(spark, sf).select(F.col("id").alias("theorem"), F.explode("symbols").alias("axiom"))


def axiom_usage(spark: SparkSession, sf: str) -> DataFrame:
    return audits.axiom_usage(_uses(spark, sf))


def assumption_compare(spark: SparkSession, sf: str) -> DataFrame:
    return audits.compare_assumptions(_uses(spark, sf).filter(F.col("theorem").isin(*COMPARED)), len(COMPARED))


def weakest(spark: SparkSession, sf: str) -> DataFrame:
    return audits.weakest(declarations(spark, sf).select(F.col("id").alias("theorem"), F.col("symbols").alias("axioms")))


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier constrains a part to quantities within ten percent of what it delivered."""
    rows = read_table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", "l_quantity")
    return rows.select("l_partkey", "l_suppkey", "l_orderkey", F.floor(F.col("l_quantity") * 0.5).alias("low"), F.ceil(F.col("l_quantity") * 1.5).alias("high"))


def version_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return audits.version_ranges(_ranges(spark, sf), "l_partkey")


def relaxations(spark: SparkSession, sf: str) -> DataFrame:
    return audits.relaxations(_ranges(spark, sf), "l_partkey", "l_orderkey").distinct()


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded symbol frequencies of shard 0 against shard 1."""
    rows = read_table(spark, sf, "symbol_freq").select("shard", strip("symbol").alias("symbol"), "freq").filter("symbol <> ''")
    shard = lambda k: rows.filter(F.col("shard") == k).groupBy("symbol").agg(F.max("freq").alias("freq"))
    return audits.snapshot_diff(shard(0), shard(1), "symbol", "freq")


def merge_libraries(spark: SparkSession, sf: str) -> DataFrame:
    """Shards as libraries, merged under new ids."""
    return audits.merge_declarations(declarations(spark, sf).select(F.col("shard").alias("library"), "id", "name"))


def merge_edges(spark: SparkSession, sf: str) -> DataFrame:
    shards = declarations(spark, sf).select(F.col("id").alias("src"), F.col("shard").alias("library"))
    edges = read_table(spark, sf, "dependencies").select("src", "dst", F.lower(strip("relation")).alias("relation")).join(shards, "src")
    return audits.merge_edges(edges, merge_libraries(spark, sf))


QUERIES = {f.__name__: f for f in (axiom_usage, assumption_compare, weakest, version_conflicts, relaxations, snapshot_diff, merge_libraries, merge_edges)}

_R = "r AS (SELECT l_partkey, l_orderkey, CAST(floor(l_quantity * 0.5) AS BIGINT) AS low, CAST(ceil(l_quantity * 1.5) AS BIGINT) AS high, row_number() OVER () AS n FROM lineitem)"
_B = "chr(32) || chr(9) || chr(10) || chr(13)"
_M = "m AS (SELECT shard AS library, id AS old_id, row_number() OVER (ORDER BY shard, name) AS id, name FROM d)"

ORACLES = {
    "axiom_usage": f"WITH {decl_sql()} SELECT axiom, count(*) AS theorems FROM (SELECT unnest(symbols) AS axiom FROM d) GROUP BY axiom",
    "assumption_compare": f"WITH {decl_sql()} SELECT axiom, count(*) AS n, CASE count(*) WHEN 3 THEN 'shared' WHEN 1 THEN 'unique' ELSE 'several' END AS relation FROM (SELECT unnest(symbols) AS axiom FROM d WHERE id IN {COMPARED}) GROUP BY axiom",
    "weakest": f"WITH {decl_sql()} SELECT id AS theorem, CAST(len(symbols) AS INTEGER) AS n FROM d WHERE len(symbols) = (SELECT min(len(symbols)) FROM d)",
    "version_conflicts": f"WITH {_R} SELECT l_partkey, max(low) AS low, min(high) AS high, count(*) AS n, count(*) > 1 AND max(low) > min(high) AS conflict FROM r GROUP BY l_partkey",
    "relaxations": f"WITH {_R}, c AS (SELECT l_partkey FROM r GROUP BY l_partkey HAVING max(low) > min(high)) SELECT DISTINCT a.l_partkey, a.l_orderkey FROM r a JOIN c USING (l_partkey) WHERE coalesce((SELECT max(b.low) <= min(b.high) FROM r b WHERE b.l_partkey = a.l_partkey AND b.n <> a.n), true)",
    "snapshot_diff": f"WITH s AS (SELECT shard, trim(symbol, {_B}) AS symbol, max(freq) AS freq FROM symbol_freq WHERE trim(symbol, {_B}) <> '' GROUP BY ALL) SELECT symbol, a.freq AS before, b.freq AS after, CASE WHEN a.shard IS NULL THEN 'new' WHEN b.shard IS NULL THEN 'removed' WHEN a.freq IS NOT DISTINCT FROM b.freq THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT * FROM s WHERE shard = 0) a FULL JOIN (SELECT * FROM s WHERE shard = 1) b USING (symbol)",
    "merge_libraries": f"WITH {decl_sql()}, {_M} SELECT * FROM m",
    "merge_edges": f"WITH {decl_sql()}, {_M} SELECT DISTINCT a.id AS src, b.id AS dst, lower(trim(relation, {_B})) AS relation FROM dependencies e JOIN d ON d.id = e.src JOIN m a ON a.old_id = e.src AND a.library = d.shard JOIN m b ON b.old_id = e.dst AND b.library = d.shard WHERE a.id <> b.id",
}
