"""Fusion of ranked lists, hybrid scores, vector search and retrieval quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fuse(ranked: DataFrame, k: int = 60, weights: Mapping[str, float] | None = None, key: str = "id", limit: int | None = None) -> DataFrame:
    """(key, score): reciprocal-rank fusion of ``ranked`` (channel, key, rank): sum of weight / (k + rank).

    Channels of weight 0 are silent; those not named weigh 1. Ties by first appearance: the smallest rank,
    then key.
    """
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.create_map(*[F.lit(x) for c, v in weights.items() for x in (c, float(v))])[F.col("channel")], F.lit(1.0))
    out = ranked.withColumn("w", w).filter("w <> 0").groupBy(key).agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 6).alias("score"), F.min("rank").alias("first"))
    out = out.orderBy(F.desc("score"), "first", key) if limit is None else out.orderBy(F.desc("score"), "first", key).limit(limit)
    return out.select(key, "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top(rows: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """(key, cosine): the ``k`` rows most similar to one query vector, exactly; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector)
    sim = dot(v, q) / F.nullif(F.sqrt(dot(v, v) * dot(q, q)), F.lit(0.0))
    return rows.filter(F.size(vector) == len(query)).select(key, F.round(sim, 6).alias("cosine")).filter("cosine is not null and not isnan(cosine)").orderBy(F.desc("cosine"), key).limit(k)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, key: str, limit: int, text_weight: float = 2.0) -> DataFrame:
    """(key, score): cosine plus ``text_weight`` times the text score over its maximum; either may be missing."""
    best = text_hits.agg(F.max("score").alias("best"))
    scaled = text_hits.crossJoin(F.broadcast(best)).select(key, (F.col("score") / F.col("best")).alias("text"))  # one row
    both = vector_hits.join(scaled, key, "full_outer")
    score = F.coalesce("cosine", F.lit(0.0)) + text_weight * F.coalesce("text", F.lit(0.0))
    return both.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def recall_at(ranked: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 3, 5), query: str = "qid", match: str = "hit") -> DataFrame:
    """(k, recall): share of ``queries`` (qid) with a hit among the first k of ``ranked`` (qid, rank, hit)."""
    first = ranked.filter(match).groupBy(query).agg(F.min("rank").alias("first"))
    every = queries.select(query).distinct().join(first, query, "left")
    return every.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "first").groupBy("k").agg(F.round(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("recall"))


def sweep(ranked: DataFrame, truth: DataFrame, grid: Sequence[tuple[int, Mapping[str, float]]], cutoff: int = 32) -> DataFrame:
    """(setting, recall): recall at ``cutoff`` of the weighted fusion under each setting of a small grid.

    ranked: qid, channel, id, rank; truth: qid, id. One pass: settings are exploded as literals.
    """
    channels = sorted({c for _, w in grid for c in w})
    settings = F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(k).alias("k"), F.create_map(*[F.lit(x) for c in channels for x in (c, float(w.get(c, 1.0)))]).alias("w")) for i, (k, w) in enumerate(grid)])
    from pyspark.sql import Window as W

    each = ranked.select("qid", "channel", "id", "rank", F.explode(settings).alias("s")).withColumn("w", F.coalesce(F.col("s.w")[F.col("channel")], F.lit(1.0))).filter("w <> 0")
    fused = each.groupBy("s.setting", "qid", "id").agg(F.sum(F.col("w") / (F.col("s.k") + F.col("rank"))).alias("score"))
    place = F.row_number().over(W.partitionBy("setting", "qid").orderBy(F.desc(F.round("score", 9)), "id"))
    top = fused.withColumn("place", place).filter(F.col("place") <= cutoff)
    hits = top.join(truth, ["qid", "id"], "left_semi").select("setting", "qid").distinct().groupBy("setting").agg(F.count(F.lit(1)).alias("hits"))
    total = truth.select("qid").distinct().agg(F.count(F.lit(1)).alias("n"))
    every = ranked.sparkSession.range(len(grid)).select(F.col("id").cast("int").alias("setting"))
    return every.join(hits, "setting", "left").crossJoin(F.broadcast(total)).select("setting", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"))
