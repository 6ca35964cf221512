"""Proof traces: quality and error reports, duplicate proofs, steps with context, premises, benchmarks.

A trace is a table of steps (project, theorem, step, state, tactic); a proof is one (project, theorem).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from theoremill.functions.scores import difficulty, domain
from theoremill.functions.texts import structured_state, tactic_family, tactic_keywords
from theoremill.runtime import cut, lookup, tokens

PROOF = ("project", "theorem")


def distribution(value: str) -> list[Column]:
    """Count, least, greatest, mean and inclusive percentiles of a column, as aggregates."""
    p = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95))))
    return [F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), *[F.round(p[i], 6).alias(c) for i, c in enumerate(("p25", "median", "p75", "p95"))]]


def quality(steps: DataFrame) -> DataFrame:
    """Distribution of proof lengths for each project and, in the row without a project, for all."""
    lengths = steps.groupBy(*PROOF).agg(F.count(F.lit(1)).alias("steps"))
    return lengths.rollup("project").agg(*distribution("steps"), F.grouping("project").alias("all"))


def vocabulary(steps: DataFrame) -> DataFrame:
    """(keyword, n): how often each tactic keyword occurs, the most frequent first."""
    return steps.select(F.explode(tactic_keywords("tactic")).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword")


def errors(records: DataFrame) -> DataFrame:
    """(file, kind, n): errors by file and kind; ``records``: file, kind."""
    return records.filter("kind is not null").groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"))


def near_timeout(records: DataFrame, seconds: str, limit: float) -> DataFrame:
    """The records that took at least nine tenths of the time limit."""
    return records.filter(F.col(seconds) >= 0.9 * limit)


def slowest(records: DataFrame, seconds: str, key: str, n: int = 20) -> DataFrame:
    return records.filter(F.col(seconds).isNotNull()).orderBy(F.desc(seconds), key).limit(n)


def duplicates(steps: DataFrame) -> DataFrame:
    """(project, theorem, cluster, size): proofs with the same first state and sequence of tactics, blanks
    between words disregarded; the cluster is named by its smallest theorem.

    A proof is known by its length and by sums of hashes of its tactics with their places, so neither a proof
    nor a cluster is ever gathered; steps are numbered within a proof by ``step``. Null states and tactics
    count as empty ones.
    """
    text = F.array_join(tokens(F.coalesce("tactic", F.lit(""))), " ")
    rows = steps.select(*PROOF, "step", F.coalesce("state", F.lit("")).alias("state"), text.alias("tactic")).withColumn("place", F.row_number().over(W.partitionBy(*PROOF).orderBy("step", "state", "tactic")))
    first = F.when(F.col("place") == 1, F.md5("state"))
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "place", "tactic").cast("decimal(20,0)"))
    proofs = rows.groupBy(*PROOF).agg(F.count(F.lit(1)).alias("n"), F.max(first).alias("state"), total(1).alias("a"), total(2).alias("b"))
    keyed = cut(proofs.select(*PROOF, F.md5(F.concat_ws(":", "n", "state", "a", "b")).alias("key")))
    clusters = keyed.groupBy("key").agg(F.min(F.concat_ws("/", *PROOF)).alias("cluster"), F.count(F.lit(1)).alias("size"))
    return lookup(keyed, clusters, "key").select(*PROOF, "cluster", "size")


def with_context(steps: DataFrame) -> DataFrame:
    """Steps with family, the family before, depth in the proof and number of goals."""
    order = W.partitionBy(*PROOF).orderBy("step")
    family = tactic_family("tactic")
    goals = F.size(F.split(F.coalesce("state", F.lit("")), "\n\n"))
    return steps.select("*", family.alias("family"), goals.alias("goals")).withColumn("previous", F.lag("family").over(order)).withColumn("depth", F.row_number().over(order) - 1)


def training_rows(steps: DataFrame) -> DataFrame:
    """Steps with their state serialised with markers."""
    return with_context(steps).withColumn("text", structured_state("state", F.col("previous"), F.col("depth"), F.col("goals")))


def benchmark(steps: DataFrame) -> DataFrame:
    """(project, theorem, steps, difficulty, domain) of each proof."""
    lengths = steps.groupBy(*PROOF).agg(F.count(F.lit(1)).alias("steps"))
    return lengths.select(*PROOF, "steps", difficulty(F.col("steps")).alias("difficulty"), domain(F.col("theorem")).alias("domain"))


def premises(rows: DataFrame, record: str, position: str, name: str) -> DataFrame:
    """(record, name, place): each record's names in order of first appearance, from 1."""
    first = rows.filter(F.col(name).isNotNull()).groupBy(record, name).agg(F.min(position).alias("first"))
    return first.select(record, name, F.row_number().over(W.partitionBy(record).orderBy("first", name)).alias("place"))


def new_constants(steps: DataFrame, constants: str) -> DataFrame:
    """Steps with ``premises``: the sorted constants that the step before didn't have."""
    order = W.partitionBy(*PROOF).orderBy("step")
    before = F.coalesce(F.lag(constants).over(order), F.array().cast("array<string>"))
    return steps.withColumn("premises", F.array_sort(F.array_except(constants, before)))


def candidates(rows: DataFrame, key: str = "tactic") -> DataFrame:
    """Candidates without those that differ from an earlier one in blanks or a rewrite's arrow only."""
    norm = F.regexp_replace(F.regexp_replace(F.btrim(key), r"\s+", " "), r"^rewrite -> ?", "rewrite ")
    return rows.withColumn("_n", norm).withColumn("_r", F.row_number().over(W.partitionBy("_n").orderBy("position"))).filter("_r = 1").drop("_n", "_r")


def state_key(goals: Column) -> Column:
    """A hash of a proof state that doesn't depend on the order of its goals."""
    return F.sha2(F.to_json(F.array_sort(goals)), 256)
