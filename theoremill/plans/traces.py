"""Queries of proof traces and training data over tactic_dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from theoremill.functions import texts
from theoremill.operators import dataset, traces
from theoremill.runtime import latest, read_table


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return latest(read_table(spark, sf, "tactic_dataset"), "pair_id", ["recorded_at"])


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset as traces: a pair is a step of its theorem's proof."""
    rows = pairs(spark, sf).filter("theorem_name is not null")
    return rows.select(F.col("project_id").alias("project"), F.col("theorem_name").alias("theorem"), F.col("pair_id").alias("step"), F.col("state_text").alias("state"), "tactic")


def _families(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("pair_id", "split", "project_id", texts.tactic_family(F.coalesce("tactic", F.lit(""))).alias("family"))


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return traces.quality(steps(spark, sf))


def tactic_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return traces.vocabulary(steps(spark, sf))


def duplicate_proofs(spark: SparkSession, sf: str) -> DataFrame:
    return traces.duplicates(steps(spark, sf)).filter("size > 1")


def duplicate_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs with the same sequence of tactics, whatever they start from."""
    return traces.duplicates(steps(spark, sf).withColumn("state", F.lit(None).cast("string"))).filter("size > 1")


def difficulty_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return traces.benchmark(steps(spark, sf)).groupBy("difficulty", "domain").agg(F.count(F.lit(1)).alias("n"))


def training_steps(spark: SparkSession, sf: str) -> DataFrame:
    return traces.with_context(steps(spark, sf)).select("step", "family", "previous", "depth", "goals")


def structured_states(spark: SparkSession, sf: str) -> DataFrame:
    return traces.training_rows(steps(spark, sf)).select("step", "text")


def first_premises(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of each order in order of first appearance."""
    rows = read_table(spark, sf, "lineitem")
    return traces.premises(rows, "l_orderkey", "l_linenumber", "l_partkey")


def goal_heads(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf).filter("state_text like '%[GOAL] %'")
    goal = F.regexp_extract("state_text", r"(?s)\[GOAL\] ([^\[]*)", 1)
    return rows.select(texts.goal_head(goal).alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("n"))


def error_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "events").filter("event_type = 'error'")
    return traces.errors(rows.select(F.col("user_id").alias("file"), F.col("event_type").alias("kind")))


def near_timeout(spark: SparkSession, sf: str) -> DataFrame:
    return traces.near_timeout(read_table(spark, sf, "events"), "value", 100.0).select("event_id", "value")


def slowest20(spark: SparkSession, sf: str) -> DataFrame:
    return traces.slowest(read_table(spark, sf, "events"), "value", "event_id").select("event_id", "value")


def tactic_families(spark: SparkSession, sf: str) -> DataFrame:
    return _families(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def collapsed_families(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.collapse(_families(spark, sf)).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def file_split(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.file_split(pairs(spark, sf), "source_file")


def library_holdout(spark: SparkSession, sf: str) -> DataFrame:
    rows = dataset.holdout(pairs(spark, sf).drop("split"), "project_id", ["danlan-base"], "pair_id")
    return rows.select("pair_id", "split")


def undersampled(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.undersample(_families(spark, sf), "family", "pair_id", 30, 5).select("pair_id", "family")


def oversampled(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.oversample(_families(spark, sf), "family", "pair_id", 40).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.class_weights(tactic_families(spark, sf))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Each test pair with its family and the most frequent family of the train pairs with as many goals."""
    rows = pairs(spark, sf).select("pair_id", "project_id", "split", texts.tactic_family(F.coalesce("tactic", F.lit(""))).alias("family"), F.regexp_extract("state_text", r"\[NGOALS=([^\]]*)\]", 1).alias("goals"))
    counts = rows.filter("split = 'train'").groupBy("goals", "family").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("r", F.row_number().over(W.partitionBy("goals").orderBy(F.desc("n"), "family"))).filter("r = 1").select("goals", F.col("family").alias("predicted"))
    return rows.filter("split = 'test'").join(best, "goals").select("pair_id", "project_id", "family", "predicted")


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.confusion(_predicted(spark, sf), "family", "predicted")


def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.precision_recall(confusion_matrix(spark, sf))


def loocv_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _predicted(spark, sf).groupBy("project_id").agg(F.avg(F.when(F.col("family") == F.col("predicted"), 1.0).otherwise(0.0)).alias("accuracy"))
    return dataset.fold_stats(rows, "accuracy")


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    tokens = pairs(spark, sf).select(F.explode(F.split(F.coalesce("tactic", F.lit("")), r"[^A-Za-z0-9_]+")).alias("token")).filter("token <> ''")
    return dataset.vocabulary(tokens, ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"])


def split_report(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.split_report(_families(spark, sf), "split", "family")


def imbalance(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.imbalance(tactic_families(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        quality_report, tactic_vocabulary, duplicate_proofs, duplicate_scripts, difficulty_buckets, training_steps, structured_states, first_premises, goal_heads, error_report,
        near_timeout, slowest20, tactic_families, collapsed_families, file_split, library_holdout, undersampled, oversampled, class_weights, confusion_matrix,
        precision_recall, loocv_stats, vocabulary, split_report, imbalance,
    )
}

_P = "p AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY recorded_at DESC NULLS LAST) AS r FROM tactic_dataset WHERE pair_id IS NOT NULL) WHERE r = 1)"
_S = f"{_P}, s AS (SELECT project_id AS project, theorem_name AS theorem, pair_id AS step, state_text AS state, tactic FROM p WHERE theorem_name IS NOT NULL)"


def _strip(x: str) -> str:
    return f"trim({x}, chr(32) || chr(9) || chr(10) || chr(13))"


def _family(x: str) -> str:
    by = f"CASE WHEN starts_with({_strip(x)}, 'by ') THEN {_strip(f'substr({_strip(x)}, 4)')} ELSE {_strip(x)} END"
    word = f"coalesce(list_filter(string_split_regex(string_split({by}, ';')[1], '[ \\t\\r\\n]+'), lambda w: w <> '')[1], '')"
    bare = f"regexp_replace(regexp_replace({word}, '[.,;:]+$', ''), '=>$', '')"
    cut = f"lower(CASE WHEN instr({bare}, '/') > 1 THEN string_split({bare}, '/')[1] ELSE {bare} END)"
    return f"CASE {cut} WHEN '' THEN 'other' WHEN 'intro' THEN 'intros' WHEN 'now' THEN 'auto' ELSE {cut} END"


_F = f"{_P}, f AS (SELECT pair_id, split, project_id, {_family(chr(99) + 'oalesce(tactic, ' + chr(39) * 2 + ')')} AS family FROM p)"
_COUNTS = f"{_F}, c AS (SELECT family, count(*) AS n FROM f GROUP BY family)"
_PREDICTED = f"""{_F}, g AS (SELECT f.*, regexp_extract(state_text, '\\[NGOALS=([^\\]]*)\\]', 1) AS goals FROM f JOIN p USING (pair_id)),
b AS (SELECT goals, family AS predicted FROM (SELECT goals, family, row_number() OVER (PARTITION BY goals ORDER BY count(*) DESC, family) AS r FROM g WHERE split = 'train' GROUP BY goals, family) WHERE r = 1),
x AS (SELECT pair_id, project_id, family, predicted FROM g JOIN b USING (goals) WHERE split = 'test'),
m AS (SELECT family AS truth, predicted, count(*) AS n FROM x GROUP BY ALL)"""
_Q = ", ".join(f"round(quantile_cont(steps, {q}), 6) AS {c}" for q, c in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95")))
_DIST = f"count(steps) AS n, min(steps) AS least, max(steps) AS most, round(avg(steps), 6) AS mean, {_Q}"



def _duplicates(state: str) -> str:
    words = "array_to_string(list_filter(string_split_regex(coalesce(tactic, ''), '[ \\t\\r\\n]+'), lambda w: w <> ''), ' ')"
    return f"""WITH {_S}, k AS (SELECT project, theorem, list({words} ORDER BY step) AS t, arg_min({state}, step) AS f FROM s GROUP BY ALL),
c AS (SELECT t, f, min(concat_ws('/', project, theorem)) AS cluster, count(*) AS size FROM k GROUP BY ALL)
SELECT project, theorem, cluster, size FROM k JOIN c USING (t, f) WHERE size > 1"""


ORACLES = {
    "duplicate_proofs": _duplicates("coalesce(state, '')"),
    "duplicate_scripts": _duplicates("''"),
    "quality_report": f"WITH {_S}, l AS (SELECT project, theorem, count(*) AS steps FROM s GROUP BY ALL) SELECT project, {_DIST}, CAST(0 AS TINYINT) AS all FROM l GROUP BY project UNION ALL SELECT NULL, {_DIST}, CAST(1 AS TINYINT) FROM l".replace("AS all", 'AS "all"'),
    "tactic_vocabulary": f"WITH {_S} SELECT keyword, count(*) AS n FROM (SELECT lower(regexp_replace(coalesce(list_filter(string_split_regex(w, '[ \\t\\r\\n]+'), lambda v: v <> '')[1], ''), '[.,;]+$', '')) AS keyword FROM (SELECT unnest(string_split(tactic, ';')) AS w FROM s)) WHERE keyword <> '' GROUP BY keyword",
    "difficulty_buckets": f"WITH {_S}, l AS (SELECT project, theorem, count(*) AS steps FROM s GROUP BY ALL) SELECT CASE WHEN steps <= 5 THEN 'short' WHEN steps <= 20 THEN 'medium' ELSE 'long' END AS difficulty, CASE WHEN regexp_matches(lower(theorem), 'arith|nat') THEN 'arithmetic' WHEN regexp_matches(lower(theorem), 'algebra|ring|field') THEN 'algebra' WHEN regexp_matches(lower(theorem), 'logic|prop') THEN 'logic' ELSE 'other' END AS domain, count(*) AS n FROM l GROUP BY ALL",
    "training_steps": f"WITH {_S} SELECT step, {_family('tactic')} AS family, lag({_family('tactic')}) OVER w AS previous, CAST(row_number() OVER w - 1 AS INTEGER) AS depth, CAST(len(string_split(coalesce(state, ''), chr(10) || chr(10))) AS INTEGER) AS goals FROM s WINDOW w AS (PARTITION BY project, theorem ORDER BY step)",
    "first_premises": "WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY ALL) SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY first, l_partkey) AS INTEGER) AS place FROM f",
    "error_report": "SELECT user_id AS file, event_type AS kind, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL",
    "near_timeout": "SELECT event_id, value FROM events WHERE value >= 90.0",
    "slowest20": "SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 20",
    "tactic_families": f"WITH {_COUNTS} SELECT * FROM c",
    "collapsed_families": f"WITH {_COUNTS} SELECT CASE WHEN n >= 50 THEN family ELSE 'other' END AS family, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1",
    "file_split": f"WITH {_P}, i AS (SELECT source_file, (row_number() OVER (ORDER BY source_file) - 1) % 10 AS i FROM (SELECT DISTINCT source_file FROM p WHERE source_file IS NOT NULL)) SELECT source_file, CASE i WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM i",
    "library_holdout": f"WITH {_P} SELECT pair_id, CASE WHEN project_id = 'danlan-base' THEN 'test' WHEN CAST('0x' || substr(md5(CAST(pair_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM p",
    "undersampled": f"WITH {_COUNTS} SELECT pair_id, family FROM (SELECT pair_id, family, row_number() OVER (PARTITION BY family ORDER BY md5(CAST(pair_id AS VARCHAR)), pair_id) AS r FROM f) JOIN c USING (family) WHERE r <= 30 AND n >= 5",
    "oversampled": f"WITH {_COUNTS} SELECT family, greatest(n, 40) AS n FROM c",
    "class_weights": f"WITH {_COUNTS} SELECT family, round(pow((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 0.5), 6) AS weight FROM c",
    "confusion_matrix": f"WITH {_PREDICTED} SELECT * FROM m",
    "precision_recall": f"WITH {_PREDICTED}, l AS (SELECT truth AS label FROM m UNION SELECT predicted FROM m), h AS (SELECT label, coalesce((SELECT sum(n) FROM m WHERE truth = label AND predicted = label), 0) AS h, coalesce((SELECT sum(n) FROM m WHERE predicted = label), 0) AS p, coalesce((SELECT sum(n) FROM m WHERE truth = label), 0) AS t FROM l) SELECT label, round(CASE WHEN p > 0 THEN h / p ELSE 0.0 END, 6) AS precision, round(CASE WHEN t > 0 THEN h / t ELSE 0.0 END, 6) AS recall, CAST(t AS BIGINT) AS support FROM h",
    "loocv_stats": f"WITH {_PREDICTED}, a AS (SELECT project_id, avg(CASE WHEN family = predicted THEN 1.0 ELSE 0.0 END) AS a FROM x GROUP BY project_id) SELECT round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0), 6) AS deviation, count(a) AS folds FROM a",
    "vocabulary": f"WITH {_P}, t AS (SELECT DISTINCT unnest(string_split_regex(coalesce(tactic, ''), '[^A-Za-z0-9_]+')) AS token FROM p) SELECT token, row_number() OVER (ORDER BY token) + 4 AS id FROM t WHERE token <> '' UNION ALL SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]']), unnest([0, 1, 2, 3, 4])",
    "split_report": f"WITH {_F} SELECT * FROM (SELECT split, family, count(*) AS n, CAST(row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, family) AS INTEGER) AS place FROM f GROUP BY split, family) WHERE place <= 10",
    "imbalance": f"WITH {_COUNTS}, s AS (SELECT family, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c) SELECT *, CASE WHEN share > 0.3 THEN 'dominant' ELSE 'small' END AS warning FROM s WHERE share > 0.3 OR n < 50",
}
