"""Comparison of tactics, hints against traces, conflicting instances, unfinished proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_capabilities(tactics: DataFrame) -> DataFrame:
    """(capability) that every tactic of ``tactics`` (tactic, capabilities) has."""
    total = tactics.select("tactic").distinct().count()
    each = tactics.select("tactic", F.explode("capabilities").alias("capability")).distinct()
    return each.groupBy("capability").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == total).select("capability")


def pairwise_differences(tactics: DataFrame) -> DataFrame:
    """(a, b, only_a, only_b) for each pair of the few compared tactics, a before b."""
    a = tactics.select(F.col("tactic").alias("a"), F.col("capabilities").alias("x"))
    b = tactics.select(F.col("tactic").alias("b"), F.col("capabilities").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.array_sort(F.array_except("x", "y")).alias("only_a"), F.array_sort(F.array_except("y", "x")).alias("only_b"))


def classify_hints(hints: DataFrame, attempts: DataFrame) -> DataFrame:
    """(hint, status): matched, attempted_but_rejected or not_considered; ``attempts``: hint, success."""
    best = attempts.groupBy("hint").agg(F.max(F.col("success").cast("int")).alias("best"))
    status = F.when(F.col("best") == 1, "matched").when(F.col("best") == 0, "attempted_but_rejected").otherwise("not_considered")
    return hints.select("hint").distinct().join(best, "hint", "left").select("hint", status.alias("status"))


def instance_conflicts(trace: DataFrame) -> DataFrame:
    """(goal, chosen, n): goals with two or more successful instances; the first by ``place`` is chosen."""
    roots = trace.filter("success").groupBy("goal").agg(F.min(F.struct("place", "instance")).alias("m"), F.count(F.lit(1)).alias("n"))
    return roots.filter("n > 1").select("goal", F.col("m.instance").alias("chosen"), "n")


def unfinished(sources: DataFrame) -> DataFrame:
    """(file, line, kind): lines of ``sources`` (file, text) that admit a goal outside comments.

    Comments without nested ones are blanked first, keeping their line breaks.
    """
    blank = F.regexp_replace("text", r"\(\*(?:(?!\*\)|\(\*)[^\n])*\*\)", "")
    lines = sources.select("file", F.posexplode(F.split(blank, "\r?\n")).alias("at", "value"))
    kind = F.regexp_extract("value", r"\b(admit|Admitted|give_up)\s*\.", 1)
    return lines.filter(kind != "").select("file", (F.col("at") + 1).alias("line"), kind.alias("kind"))
