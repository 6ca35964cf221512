"""Queries of timing analytics over events: a user is a file, an event a sentence, ``value`` its seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from theoremill.operators import timing
from theoremill.runtime import read_table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts", at.alias("at"))


def _spans(events: DataFrame) -> DataFrame:
    """Spans from each signup of a user to the next one."""
    order = W.partitionBy("user_id").orderBy("at", "event_id")
    rows = events.filter("event_type = 'signup'").withColumn("end", F.lead("at").over(order))
    return rows.filter("end is not null").select("user_id", F.col("at").alias("start"), "end", F.col("event_id").alias("span"))


def interval_assign(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    points = events.filter("event_type <> 'signup'").select(F.col("event_id").alias("point"), "user_id", "at")
    return timing.interval_join(points, _spans(events), "user_id", "at", "start", "end", 30 * 86_400).select("point", "span")


def asof_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The latest click of the same user at or before each purchase."""
    events = _events(spark, sf)
    clicks = events.filter("event_type = 'click'").groupBy("user_id", "at").agg(F.max("event_id").alias("click"))
    return timing.asof_join(events.filter("event_type = 'purchase'").select("user_id", "at", "event_id"), clicks, "user_id", "at", "click").select("event_id", "click")


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The whole table as two runs to compare: even events are the first, odd ones the second."""
    rows = _events(spark, sf).withColumnRenamed("event_id", "id")
    return rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")


def match_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _halves(spark, sf)
    return timing.match_occurrences(a, b, ["user_id", "event_type"], ["at", "id"])


def band_match(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _halves(spark, sf)
    return timing.band_match(a, b, "user_id", "at", 86_400)


def timing_diff(spark: SparkSession, sf: str) -> DataFrame:
    sums = [h.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("seconds")) for h in _halves(spark, sf)]
    return timing.compare(*sums, ["user_id", "event_type"])


def proof_rollup(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "ProofClose").otherwise("Tactic")
    rows = _events(spark, sf).withColumn("kind", kind).withColumn("pos", F.struct("at", "event_id"))
    return timing.rollup(rows, ["user_id"], "kind", "value", "pos")


def bottlenecks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "ProofClose").otherwise("Tactic").alias("kind"), F.when(F.col("event_type") == "view", "simpl in H").otherwise("eauto 9").alias("snippet"), F.col("value").alias("seconds"))
    return timing.bottlenecks(rows, 1000.0).select("id", "category", "severity", "place")


def session_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user that end after 30 idle minutes (batch form of the streaming sweep)."""
    from theoremill.streaming.sessions import sessions

    return sessions(_events(spark, sf), "user_id", "ts").select("user_id", F.unix_seconds(F.col("begins").cast("timestamp")).alias("begins"), "events")


QUERIES = {f.__name__: f for f in (interval_assign, asof_lookup, match_occurrence, band_match, timing_diff, proof_rollup, bottlenecks, session_gaps)}

_E = "e AS (SELECT event_id, user_id, event_type, value, ts, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events)"

ORACLES = {
    "interval_assign": f"WITH {_E}, s AS (SELECT user_id, pos AS start, lead(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS stop, event_id AS span FROM e WHERE event_type = 'signup') SELECT e.event_id AS point, (SELECT span FROM s WHERE s.user_id = e.user_id AND e.pos >= s.start AND e.pos < s.stop ORDER BY s.start, span LIMIT 1) AS span FROM e WHERE event_type <> 'signup'",
    "asof_lookup": f"WITH {_E}, c AS (SELECT user_id, pos, max(event_id) AS click FROM e WHERE event_type = 'click' GROUP BY ALL) SELECT p.event_id, c.click FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.pos >= c.pos",
    "match_occurrence": f"WITH {_E}, n AS (SELECT event_id, user_id, event_type, event_id % 2 AS h, CAST(row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY pos, event_id) AS INTEGER) AS k FROM e) SELECT a.user_id, a.event_type, a.k, a.event_id AS \"left\", b.event_id AS \"right\" FROM n a JOIN n b USING (user_id, event_type, k) WHERE a.h = 0 AND b.h = 1",
    "timing_diff": "WITH s AS (SELECT user_id, event_type, event_id % 2 AS h, round(sum(value), 6) AS s FROM events GROUP BY ALL), j AS (SELECT user_id, event_type, a.s AS before, b.s AS after, coalesce(b.s, 0) - coalesce(a.s, 0) AS d FROM (SELECT * FROM s WHERE h = 0) a FULL JOIN (SELECT * FROM s WHERE h = 1) b USING (user_id, event_type)) SELECT user_id, event_type, before, after, round(d, 6) AS delta, CASE WHEN after IS NULL THEN 'removed' WHEN before IS NULL THEN 'added' WHEN abs(d) > 0.5 AND abs(d) > 0.2 * before AND d > 0 THEN 'slower' WHEN abs(d) > 0.5 AND abs(d) > 0.2 * before THEN 'faster' ELSE 'same' END AS verdict FROM j",
    "proof_rollup": f"WITH {_E}, r AS (SELECT user_id, round(coalesce(sum(value) FILTER (event_type <> 'purchase'), 0), 6) AS tactics, round(coalesce(arg_max(value, (pos, event_id)) FILTER (event_type = 'purchase'), 0), 6) AS close FROM e GROUP BY user_id) SELECT *, round(tactics + close, 6) AS total FROM r",
    "bottlenecks": "WITH c AS (SELECT event_id AS id, value, CASE WHEN event_type = 'purchase' AND value > 2 AND value > 5 * greatest(0, 1000 - value) THEN 'SlowQed' WHEN event_type = 'view' AND value > 2 THEN 'SlowReduction' WHEN event_type <> 'view' AND value > 1 THEN 'HighSearchDepth' END AS category FROM events), t AS (SELECT * FROM c WHERE category IS NOT NULL ORDER BY value DESC, id LIMIT 5) SELECT id, category, CASE WHEN value / 1000 > 0.5 OR value > CASE category WHEN 'HighSearchDepth' THEN 5 ELSE 10 END THEN 'critical' ELSE 'warning' END AS severity, CAST(row_number() OVER (ORDER BY value DESC, id) AS INTEGER) AS place FROM t",
    "session_gaps": "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS begins, count(*) AS events FROM g GROUP BY user_id, g",
}
