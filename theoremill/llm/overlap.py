"""The same or nearly the same records across splits, by a weighted cosine join.

Records become unit vectors of term weights; records with the same set of terms form one class, and the
join runs between classes. Terms are ordered rare first. A class is listed only under the terms of its
prefix: the rest of the vector is so short (residual norm) and light (times the greatest weight on the
other side) that by itself it cannot reach the threshold. Two listed terms make a candidate only if their
product and the two residual norms can still reach it. Candidates get exact dot products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.runtime import BLANKS, cut, latest, lookup, salted_join

#: Terms of several classes whose numbers of classes may be broadcast, after they have been counted: 16 bytes
#: each. Beyond, the numbers are joined by shuffle; either way they are exact and the result is the same.
TABLE_TERMS = 500_000

_SLACK = 1e-9


def term_classes(records: DataFrame, key: str, text: str, side: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(classes, members): classes of records with the same set of at least ``least`` lower-cased terms.

    classes: cls (smallest key of the class), terms (64-bit hashes, ascending), and whether it has left and
    right records; members: cls, key, side. Keys must be unique. A class may hold most of the records: only
    its name is joined to them, split where it is hot.
    """
    words = F.array_distinct(F.array_remove(F.split(F.lower(text), f"[{BLANKS}]+"), ""))
    sets = records.select(F.col(key).alias("key"), F.col(side).alias("side"), F.sort_array(F.transform(words, lambda x: F.xxhash64(x))).alias("terms")).filter(F.size("terms") >= least)
    hashed = cut(sets.select(F.concat_ws(":", F.xxhash64("terms"), F.xxhash64(F.lit(1), "terms")).alias("same"), "key", "side", "terms"))
    flag = lambda s: F.max((F.col("side") == s).cast("int")).alias(f"is_{s}")
    named = cut(hashed.groupBy("same").agg(F.min("key").alias("cls"), flag("left"), flag("right")))
    members = cut(lookup(hashed.select("same", "key", "side"), named.select("same", "cls"), "same").drop("same"))
    return named.drop("same").join(hashed.select(F.col("key").alias("cls"), "terms"), "cls"), members


def document_frequencies(classes: DataFrame) -> DataFrame:
    """(cls, terms, dfs, is_left, is_right): ``dfs`` says in how many classes each of ``terms`` is, exactly."""
    df = cut(classes.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    if (n := df.count()) > TABLE_TERMS:
        numbered = lookup(classes.select("cls", F.explode("terms").alias("t")), df, "t", "left")
        lists = numbered.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("t", F.coalesce("df", F.lit(1).cast("long")).alias("df")))).alias("l"))
        return classes.drop("terms").join(lists, "cls").select("cls", F.col("l.t").alias("terms"), F.col("l.df").alias("dfs"), "is_left", "is_right")
    rows = df.toPandas()  # at most TABLE_TERMS rows of two numbers
    by = np.argsort(rows["t"].to_numpy(np.int64)) if n else []
    shared = classes.sparkSession.sparkContext.broadcast((rows["t"].to_numpy(np.int64)[by], rows["df"].to_numpy(np.int64)[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = shared.value
        for batch in batches:
            lists = batch.column("terms")
            flat = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
            dfs = np.where(terms[at] == flat, counts[at], 1) if len(terms) else np.ones(len(flat), np.int64)
            offsets = pa.array(np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), lists, pa.ListArray.from_arrays(offsets, pa.array(dfs)), batch.column("is_left"), batch.column("is_right")], ["cls", "terms", "dfs", "is_left", "is_right"])

    return classes.select("cls", "terms", "is_left", "is_right").mapInArrow(run, "cls long, terms array<long>, dfs array<long>, is_left int, is_right int")


def _prefixes(classes: DataFrame, kind: str, total: int, threshold: float, heaviest: float) -> DataFrame:
    """(term, cls, w, rest, n, top) for the listed terms; ``heaviest``: the greatest weight of any vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("terms")
            flat, df, sizes = lists.flatten().to_numpy(), batch.column("dfs").flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            by = np.lexsort((flat, df, row))
            flat, row = flat[by], row[by]
            w = np.ones(len(flat)) if kind == "binary" else np.log1p(total / df[by])
            w = w / np.sqrt(np.bincount(row, w * w, len(sizes)))[row]
            # What is left of each vector from a position on: by norm, and by weights.
            norm2, light = (np.cumsum(x) for x in (w * w, w))
            last = np.cumsum(sizes) - 1
            rest2, rest1 = norm2[last][row] - norm2, light[last][row] - light
            from_here = np.minimum(np.sqrt(np.maximum(rest2 + w * w, 0)), (rest1 + w) * heaviest)
            keep = np.flatnonzero((from_here >= threshold - _SLACK) & (df[by] > 1))  # a term of one class makes no pair
            top = np.zeros(len(sizes))
            np.maximum.at(top, row, w)
            cls = batch.column("cls").to_numpy()[row]
            columns = [flat[keep], cls[keep], w[keep], np.sqrt(np.maximum(rest2[keep], 0)), sizes[row][keep].astype(np.int32), top[row][keep]]
            flags = [batch.column(c).take(pa.array(row[keep])) for c in ("is_left", "is_right")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *flags], ["term", "cls", "w", "rest", "n", "top", "is_left", "is_right"])

    return classes.mapInArrow(run, "term long, cls long, w double, rest double, n int, top double, is_left int, is_right int")


def cosine_join(classes: DataFrame, threshold: float, weights: str = "binary") -> DataFrame:
    """(left, right, dot, shared, n_left, n_right): all pairs of different classes, one with left and one
    with right records, whose dot product is at least ``threshold``. No pair is lost.

    ``weights``: ``binary`` gives each term the weight 1, ``idf`` log(1 + classes / classes with the term).
    """
    vectors = cut(document_frequencies(classes))
    total, least = vectors.agg(F.count(F.lit(1)), F.min(F.size("terms"))).first()
    lists = cut(_prefixes(vectors, weights, total, threshold, 1 / math.sqrt(least or 1) if weights == "binary" else 1.0))
    fields = ("cls", "w", "rest", "n", "top")
    left = lists.filter("is_left = 1").select("term", *[F.col(c).alias(f"{c}_l") for c in fields])
    right = lists.filter("is_right = 1").select("term", *[F.col(c).alias(f"{c}_r") for c in fields])
    reach = F.col("w_l") * F.col("w_r") + F.col("rest_l") * F.col("rest_r") >= threshold - _SLACK
    size = F.least("n_l", "n_r") * F.col("top_l") * F.col("top_r") >= threshold - _SLACK
    pairs = cut(salted_join(left, right, "term").filter((F.col("cls_l") != F.col("cls_r")) & reach & size).select("cls_l", "cls_r").distinct())
    held = ("terms",) if weights == "binary" else ("terms", "dfs")
    side = lambda end: vectors.select(F.col("cls").alias(f"cls_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in held])
    both = lookup(lookup(pairs, side("l"), "cls_l"), side("r"), "cls_r")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = [batch.column(f"{c}_{end}") for end in "lr" for c in held]
            for of in zip(*lists):
                x, y = of[0].values.to_numpy(), of[len(held)].values.to_numpy()
                if weights == "binary":
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    dot = common / math.sqrt(len(x) * len(y))
                else:
                    u, v = (np.log1p(total / of[k].values.to_numpy()) ** 2 for k in (1, 3))
                    inside = np.isin(x, y, assume_unique=True)
                    common, dot = int(inside.sum()), float(u[inside].sum() / math.sqrt(u.sum() * v.sum()))
                rows.append((dot, common, len(x), len(y)))
            columns = list(zip(*rows)) or [[]] * 4
            made = [pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("cls_l"), batch.column("cls_r"), *made], ["left", "right", "dot", "shared", "n_left", "n_right"])

    found = both.mapInArrow(dots, "left long, right long, dot double, shared int, n_left int, n_right int")
    return found.filter(F.col("dot") >= threshold - _SLACK)


def _linked_classes(dataset: DataFrame, jaccard: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs of classes (left, right) whose records overlap, and the records of each class."""
    rows = latest(dataset.select("pair_id", "split", "state_text", "recorded_at"), "pair_id", ["recorded_at"])
    split = F.lower(F.btrim("split"))
    sided = rows.select(F.col("pair_id").cast("long").alias("pair_id"), "state_text", F.when(split == "train", "left").when(split.isin("val", "test"), "right").alias("side")).filter("side is not null and state_text is not null")
    classes, members = term_classes(sided, "pair_id", "state_text", "side", least)
    classes = cut(classes)
    near = cosine_join(classes, 2 * jaccard / (1 + jaccard)).filter(F.col("shared") >= jaccard * (F.col("n_left") + F.col("n_right") - F.col("shared")) - _SLACK)
    same = classes.filter("is_left = 1 and is_right = 1").select(F.col("cls").alias("left"), F.col("cls").alias("right"))
    return cut(near.select("left", "right").unionByName(same)), members


def split_overlaps(dataset: DataFrame, jaccard: float = 0.8, least: int = 15) -> DataFrame:
    """(train_id, other_id): each pair of a train record and a val or test record whose sets of lower-cased
    state_text tokens have at least ``least`` members each and a Jaccard similarity of ``jaccard`` or more.

    A Jaccard similarity of j means a cosine of at least 2j / (1 + j) between binary vectors, so the cosine
    join finds all; the exact Jaccard test follows. Of rows with one pair_id the latest recorded_at counts.
    Null, empty and short texts, other splits and null ids take no part.
    """
    links, members = _linked_classes(dataset, jaccard, least)
    left = members.filter("side = 'left'").select(F.col("cls").alias("left"), F.col("key").alias("train_id"))
    right = members.filter("side = 'right'").select(F.col("cls").alias("right"), F.col("key").alias("other_id"))
    return salted_join(salted_join(left, links, "left").drop("left"), right, "right").select("train_id", "other_id")


def overlap_report(dataset: DataFrame, clusters: DataFrame, jaccard: float = 0.8, least: int = 15) -> DataFrame:
    """Per split and project of the val and test records: ``pairs``, ``records`` that have one, and ``known``,
    the pairs whose two theorem names stand together in a row of clusters.members.

    Pairs are counted, never made: by the sizes of linked classes; known ones by the sizes of the parts of a
    class whose names stand in the same clusters (``sig``). Null names are known nowhere; of repeated
    cluster_ids every row counts.
    """
    links, members = _linked_classes(dataset, jaccard, least)
    rows = latest(dataset.select("pair_id", "split", "project_id", "theorem_name", "recorded_at"), "pair_id", ["recorded_at"]).select(F.col("pair_id").cast("long").alias("key"), "split", "project_id", F.col("theorem_name").alias("name"))
    numbered = clusters.select(F.xxhash64("cluster_id", "members").alias("cluster"), F.explode(F.array_distinct("members")).alias("name")).filter("name is not null").distinct()
    sigs = cut(numbered.groupBy("name").agg(F.array_sort(F.collect_set("cluster")).alias("clusters")).withColumn("sig", F.md5(F.array_join(F.transform("clusters", lambda c: c.cast("string")), ","))))
    used = cut(members.join(rows, "key"))
    parts = cut(lookup(used, sigs.select("name", "sig"), "name", "left").groupBy("cls", "side", "split", "project_id", "sig").agg(F.count(F.lit(1)).alias("n")))
    left, right = parts.filter("side = 'left'"), parts.filter("side = 'right'")

    # Every record of a right class has as many partners as its linked left classes have records.
    sizes = left.groupBy(F.col("cls").alias("left")).agg(F.sum("n").alias("size"))
    partners = lookup(links, sizes, "left").groupBy(F.col("right").alias("cls")).agg(F.sum("size").alias("partners"))
    counted = lookup(right, partners, "cls").groupBy("split", "project_id").agg(F.sum(F.col("n") * F.col("partners")).alias("pairs"), F.sum("n").alias("records"))

    each = sigs.select("sig", F.explode("clusters").alias("cluster")).distinct()
    together = cut(salted_join(each.select("cluster", F.col("sig").alias("sig_r")), each.select("cluster", F.col("sig").alias("sig_l")), "cluster").select("sig_l", "sig_r").distinct())
    of_left = left.filter("sig is not null").groupBy(F.col("cls").alias("left"), F.col("sig").alias("sig_l")).agg(F.sum("n").alias("m"))
    spots = right.filter("sig is not null").select(F.col("cls").alias("right"), F.col("sig").alias("sig_r")).distinct()
    meant = salted_join(salted_join(spots, together, "sig_r"), links, "right").join(of_left, ["left", "sig_l"]).groupBy("right", "sig_r").agg(F.sum("m").alias("m"))
    known = (
        right.filter("sig is not null").select(F.col("cls").alias("right"), F.col("sig").alias("sig_r"), "split", "project_id", "n").join(meant, ["right", "sig_r"])
        .groupBy("split", "project_id").agg(F.sum(F.col("n") * F.col("m")).alias("known"))
    )
    same = lambda a, b: a["split"].eqNullSafe(b["split"]) & a["project_id"].eqNullSafe(b["project_id"])
    return counted.join(known, same(counted, known), "left").select(counted["split"], counted["project_id"], "pairs", "records", F.coalesce("known", F.lit(0).cast("long")).alias("known"))
