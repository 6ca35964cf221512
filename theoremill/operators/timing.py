"""Timing logs: interval, as-of, positional and band joins, roll-ups, comparison of runs, bottlenecks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from theoremill.functions.scores import bottleneck, severity


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with the span [start, end) of its key that holds it, the first by start; null if none.

    Spans are entered into buckets of ``width`` and points looked up by (key, bucket), so neither a theta
    join nor a whole key in one task is needed. Points need a unique column ``point``.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    entered = spans.filter(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(bucket(start), F.floor((F.col(end) - 1) / width))))
    hits = points.select("point", key, at, bucket(at).alias("_b")).join(entered, [key, "_b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    first = hits.groupBy("point").agg(F.min(F.struct(start, "span")).alias("_m")).select("point", F.col("_m.span").alias("span"))
    return points.join(first, "point", "left")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the latest row of ``right`` of the same key that is no later; null if none.

    One sorted pass over the union of both sides.
    """
    columns = [c for c in left.columns if c not in (key, at)]
    both = left.select(key, at, F.lit(1).alias("_side"), *columns, F.lit(None).cast(dict(right.dtypes)[value]).alias(value)).unionByName(
        right.select(key, at, F.lit(0).alias("_side"), *[F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in columns], value)
    )
    last = F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(value, last).filter("_side = 1").drop("_side")


def line_numbers(offsets: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, offset, line): the line in which each byte offset lies; ``starts``: file, offset, line."""
    return asof_join(offsets.select("file", "offset"), starts, "file", "offset", "line")


def match_occurrences(a: DataFrame, b: DataFrame, text: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The k-th occurrence of a text in one run with the k-th in the other: text, k, left, right (ids)."""

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*text, F.row_number().over(W.partitionBy(*text).orderBy(*order)).alias("k"), F.col("id").alias(name))

    return numbered(a, "left").join(numbered(b, "right"), [*text, "k"])


def band_match(a: DataFrame, b: DataFrame, key: str, offset: str, width: float = 500) -> DataFrame:
    """(key, left, right): greedy pairing of rows whose offsets differ by at most ``width``, in order; each
    row is used once. The greedy choice is sequential, so each key is folded in one pass in pandas."""
    both = a.select(key, "id", offset, F.lit(0).alias("side")).unionByName(b.select(key, "id", offset, F.lit(1).alias("side")))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([offset, "id"])
        left, right = (rows[rows.side == s] for s in (0, 1))
        free, out, begin = list(zip(right[offset], right["id"])), [], 0
        used = [False] * len(free)
        for at, i in zip(left[offset], left["id"]):
            while begin < len(free) and (used[begin] or free[begin][0] < at - width):
                begin += 1
            for j in range(begin, len(free)):
                if free[j][0] > at + width:
                    break
                if not used[j]:
                    used[j] = True
                    out.append((rows[key].iloc[0], i, free[j][1]))
                    break
        return pd.DataFrame(out, columns=[key, "left", "right"])

    types = dict(both.dtypes)
    return both.groupBy(key).applyInPandas(fold, f"{key} {types[key]}, left {types['id']}, right {types['id']}")


def rollup(sentences: DataFrame, proof: Sequence[str], kind: str, seconds: str, at: str) -> DataFrame:
    """(proof, tactics, close, total): seconds in tactics, in the last closing sentence, and together."""
    tactics = F.coalesce(F.sum(F.when(F.col(kind) == "Tactic", F.col(seconds))), F.lit(0.0))
    close = F.coalesce(F.max(F.when(F.col(kind) == "ProofClose", F.struct(at, seconds)))[seconds], F.lit(0.0))
    return sentences.groupBy(*proof).agg(F.round(tactics, 6).alias("tactics"), F.round(close, 6).alias("close")).withColumn("total", F.round(F.col("tactics") + F.col("close"), 6))


def compare(a: DataFrame, b: DataFrame, key: Sequence[str], seconds: str = "seconds", relative: float = 0.2, absolute: float = 0.5) -> DataFrame:
    """(key, before, after, delta, verdict) of two runs: removed, added, slower, faster or same."""
    both = a.select(*key, F.col(seconds).alias("before")).join(b.select(*key, F.col(seconds).alias("after")), list(key), "full_outer")
    delta = F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    large = (F.abs(delta) > absolute) & (F.abs(delta) > relative * F.col("before"))
    verdict = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(large & (delta > 0), "slower").when(large, "faster").otherwise("same")
    return both.select(*key, "before", "after", F.round(delta, 6).alias("delta"), verdict.alias("verdict"))


def bottlenecks(sentences: DataFrame, total: float, n: int = 5) -> DataFrame:
    """The ``n`` slowest classified sentences (id, kind, snippet, seconds) with category, severity and place."""
    category = bottleneck(F.col("kind"), F.col("snippet"), F.col("seconds"), F.lit(total))
    found = sentences.withColumn("category", category).filter("category is not null").orderBy(F.desc("seconds"), "id").limit(n)
    return found.withColumn("severity", severity(F.col("category"), F.col("seconds"), F.lit(total))).withColumn("place", F.row_number().over(W.orderBy(F.desc("seconds"), "id")))  # n rows
