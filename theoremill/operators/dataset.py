"""Training data of tactic prediction: families, splits, sampling, vocabulary, weights and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from theoremill.runtime import lookup, row_index


def collapse(rows: DataFrame, family: str = "family", least: int = 50) -> DataFrame:
    """``rows`` with families of fewer than ``least`` rows called 'other'."""
    small = rows.groupBy(family).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(family, F.col(family).alias("_kept"))
    return lookup(rows, small, family, "left").withColumn(family, F.coalesce("_kept", F.lit("other"))).drop("_kept")


def file_split(files: DataFrame, file: str) -> DataFrame:
    """(file, split): every tenth file in sorted order, counting from 8 and 9, is for validation and test."""
    turn = F.pmod("index", F.lit(10))
    placed = row_index(files.filter(F.col(file).isNotNull()).select(file).distinct(), [file])
    return placed.select(file, F.when(turn == 8, "val").when(turn == 9, "test").otherwise("train").alias("split"))


def holdout(rows: DataFrame, library: str, held: Sequence[str], key: str, val: float = 0.1) -> DataFrame:
    """``rows`` with a split: held-out libraries are for test, of the rest ``val`` by the key's hash for validation."""
    part = F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(F.col(library).isin(*held), "test").when(part < val, "val").otherwise("train"))


def undersample(rows: DataFrame, family: str, key: str, cap: int, least: int = 0) -> DataFrame:
    """At most ``cap`` rows of each family, in the order of the key's md5; families of fewer than ``least``
    rows are left out. Each map task passes on no more than ``cap`` rows of a family."""
    order = W.partitionBy(family).orderBy(F.md5(F.col(key).cast("string")), key)
    picked = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap).drop("_r")
    if not least:
        return picked
    enough = rows.groupBy(family).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(family)
    return picked.join(enough, family, "left_semi")


def oversample(rows: DataFrame, family: str, key: str, floor: int) -> DataFrame:
    """``rows`` plus copies (copy > 0) of those in families below ``floor``, so that each reaches it; a
    family's rows are repeated in turn, in the order of the key's md5."""
    sizes = rows.groupBy(family).agg(F.count(F.lit(1)).alias("_n"))
    small = rows.join(sizes.filter(F.col("_n") < floor), family)
    place = F.row_number().over(W.partitionBy(family).orderBy(F.md5(F.col(key).cast("string")), key))  # fewer than floor rows each
    times = F.floor((F.lit(floor) - F.col("_p")) / F.col("_n")).cast("int")
    copies = small.withColumn("_p", place).withColumn("_t", times).filter("_t > 0").select(*rows.columns, F.explode(F.sequence(F.lit(1), "_t")).alias("copy"))
    return rows.withColumn("copy", F.lit(0)).unionByName(copies)


def class_weights(counts: DataFrame, family: str = "family", alpha: float = 0.5) -> DataFrame:
    """(family, weight): (total / (families * n)) ^ alpha. ``counts``: family, n."""
    total = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c"))
    return counts.crossJoin(F.broadcast(total)).select(family, F.round(F.pow(F.col("t") / (F.col("c") * F.col("n")), F.lit(alpha)), 6).alias("weight"))  # one row


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, support) from a confusion matrix; 0 where nothing was predicted or true."""
    sides = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(0).alias("p"), F.col("n").alias("t")), F.struct(F.col("predicted").alias("label"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")))).alias("s"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    sums = sides.groupBy("s.label").agg((F.sum("hit") / 2).alias("hit"), F.sum("s.p").alias("p"), F.sum("s.t").alias("t"))
    share = lambda c: F.round(F.when(F.col(c) > 0, F.col("hit") / F.col(c)).otherwise(0.0), 6)
    return sums.select("label", share("p").alias("precision"), share("t").alias("recall"), F.col("t").alias("support"))


def accuracy_at(ranked: DataFrame, k: Sequence[int] = (1, 5)) -> DataFrame:
    """(k, accuracy) of ``ranked`` (id, rank, hit), ranks from 1."""
    best = ranked.groupBy("id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return best.select(F.explode(F.array(*map(F.lit, k))).alias("k"), "first").groupBy("k").agg(F.round(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def fold_stats(folds: DataFrame, value: str) -> DataFrame:
    """Mean and sample deviation over folds; the deviation of a single one is 0."""
    return folds.agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("deviation"), F.count(value).alias("folds"))


def softmax_top(scores: DataFrame, query: str, label: str, score: str, k: int) -> DataFrame:
    """(query, label, probability): the ``k`` most probable labels of each query."""
    per = W.partitionBy(query)
    e = scores.withColumn("_e", F.exp(F.col(score) - F.max(score).over(per)))
    p = e.withColumn("probability", F.round(F.col("_e") / F.sum("_e").over(per), 6))
    return p.withColumn("_r", F.row_number().over(per.orderBy(F.desc(score), label))).filter(F.col("_r") <= k).select(query, label, "probability")


def vocabulary(tokens: DataFrame, special: Sequence[str]) -> DataFrame:
    """(token, id): ids from 0, special tokens first, then all others of ``tokens`` (token) in order."""
    rest = tokens.filter(F.col("token").isNotNull() & ~F.col("token").isin(*special)).select("token").distinct()
    first = tokens.sparkSession.createDataFrame(list(zip(special, range(len(special)))), "token string, id long")
    return first.unionByName(row_index(rest, ["token"], "id").select("token", (F.col("id") + len(special)).alias("id")))


def split_report(rows: DataFrame, split: str, family: str, top: int = 10) -> DataFrame:
    """(split, family, n, place): the most frequent families of each split."""
    counts = rows.groupBy(split, family).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(split).orderBy(F.desc("n"), family))).filter(F.col("place") <= top)


def imbalance(counts: DataFrame, dominant: float = 0.3, small: int = 50) -> DataFrame:
    """(family, n, share, warning) of the families that hold more than ``dominant`` of all or fewer than ``small``."""
    total = counts.agg(F.sum("n").alias("t"))
    shared = counts.crossJoin(F.broadcast(total)).select("family", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # one row
    return shared.withColumn("warning", F.when(F.col("share") > dominant, "dominant").when(F.col("n") < small, "small")).filter("warning is not null")
