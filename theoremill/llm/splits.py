"""Splits that keep related records together.

Records and what they share (source file, author, theorem) form a graph in star form: each record is
linked to the smallest record of the same value, never to all others. Borůvka's method contracts it: every
component takes its least link, mutual choices are broken at the smaller id, pointer doubling finds the
roots, links are relabelled and reduced to the least per pair of components. The chosen links are a
spanning forest, kept as a table. Rounds halve the components at least.

The roots are then stratified by size band and dealt to the splits systematically, the largest first, so
that what a giant group takes too much from one split is made up for by the smaller ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from theoremill.operators.hierarchy import double_pointers
from theoremill.runtime import cut, latest, lookup, release, strip

# Stand-ins for a missing author, lower-cased.
NO_AUTHOR = ("", "unknown", "n/a", "-")

SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))

#: Groups that hold more than 1/LARGE of all records are dealt one by one; there are at most LARGE.
LARGE = 10_000

#: Groups of one band that one task ranks.
ROOTS_PER_TASK = 50_000


def file_key(column: Column | str) -> Column:
    """A path without case, outer blanks, kind and number of separators and '.' steps; null if nothing is left."""
    steps = F.filter(F.split(F.lower(strip(column)), r"[/\\]+"), lambda s: (s != "") & (s != "."))
    return F.when(F.size(steps) > 0, F.array_join(steps, "/"))


def author_key(column: Column | str) -> Column:
    """An author without case and outer blanks; null for stand-ins."""
    name = F.lower(strip(column))
    return F.when(~name.isin(*NO_AUTHOR), name)


@dataclass
class Groups:
    """``members``: id, group_id (the group's smallest id); ``forest``: a, b, the links that span the groups."""

    members: DataFrame
    forest: DataFrame


def related_groups(ids: DataFrame, values: DataFrame) -> Groups:
    """Groups of the ids of ``ids`` (id) that share a row of ``values`` (id, value), directly or through others."""
    spark = ids.sparkSession
    values = cut(values.filter("id is not null and value is not null").select("id", "value").distinct())
    least = values.groupBy("value").agg(F.min("id").alias("hub"))
    links = cut(
        lookup(values, least, "value")
        .filter("id <> hub")
        .select(F.col("hub").alias("u"), F.col("id").alias("v"))
        .groupBy("u", "v")
        .agg(F.min(F.struct(F.col("u").alias("a"), F.col("v").alias("b"))).alias("link"))
    )
    labels = cut(ids.filter("id is not null").select("id").distinct().withColumn("comp", F.col("id")))
    forest = None
    while not links.isEmpty():
        both = links.select(F.col("u").alias("node"), F.col("v").alias("to"), "link").unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("to"), "link"))
        chosen = cut(both.groupBy("node").agg(F.min(F.struct("link", "to")).alias("m")).select("node", F.col("m.to").alias("to"), F.col("m.link").alias("link")))
        # Links are ordered without ties, so the only cycles are two components that chose the same link.
        back = chosen.select(F.col("node").alias("to"), F.col("to").alias("back"))
        hooked = lookup(chosen, back, "to").withColumn("root", (F.col("back") == F.col("node")) & (F.col("node") < F.col("to")))
        kept = cut(hooked.filter("not root").select("link.a", "link.b"))
        forest = kept if forest is None else forest.unionByName(kept)
        start = cut(hooked.select("node", F.when(F.col("root"), F.col("node")).otherwise(F.col("to")).alias("top"), F.when(F.col("root"), 0).otherwise(1).cast("long").alias("dist")))
        roots = double_pointers(start)[0].select(F.col("node").alias("comp"), F.col("top").alias("new"))
        labels = cut(lookup(labels, roots, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")), replaces=labels)
        moved = lookup(links, roots.select(F.col("comp").alias("u"), F.col("new").alias("x")), "u")
        moved = lookup(moved, roots.select(F.col("comp").alias("v"), F.col("new").alias("y")), "v")
        links = cut(moved.filter("x <> y").groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("link").alias("link")), replaces=links)
        release(chosen)
    smallest = labels.groupBy("comp").agg(F.min("id").alias("group_id"))
    members = lookup(labels, smallest, "comp").select("id", "group_id")
    if forest is None:
        forest = spark.createDataFrame([], f"a {labels.dtypes[0][1]}, b {labels.dtypes[0][1]}")
    return Groups(members, forest)


def dataset_values(rows: DataFrame) -> DataFrame:
    """(id, value) of what relates the pairs of a tactic dataset: normalised file, author, and theorem name."""
    kinds = {"f": file_key("source_file"), "a": author_key("author"), "t": F.col("theorem_name")}
    pairs = F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}:"), c)) for k, c in kinds.items()])
    return rows.select(F.col("pair_id").cast("long").alias("id"), F.explode(pairs).alias("value")).filter("value is not null")


def dataset_groups(dataset: DataFrame) -> tuple[DataFrame, Groups]:
    """The latest row of each pair_id (by recorded_at; null ids are left out) and the groups of all pairs."""
    rows = latest(dataset.select("pair_id", "split", "source_file", "author", "theorem_name", "recorded_at"), "pair_id", ["recorded_at"])
    return rows, related_groups(rows.select(F.col("pair_id").cast("long").alias("id")), dataset_values(rows))


def torn_groups(dataset: DataFrame) -> DataFrame:
    """(pair_id, group_id) of each pair of a group that now lies in more than one split (null is none)."""
    rows, groups = dataset_groups(dataset)
    now = cut(groups.members.join(rows.select(F.col("pair_id").cast("long").alias("id"), "split"), "id"))
    torn = now.groupBy("group_id").agg(F.min("split").alias("x"), F.max("split").alias("y")).filter("x <> y").select("group_id", F.lit(True).alias("torn"))
    return lookup(now, torn, "group_id").select(F.col("id").alias("pair_id"), "group_id")


def _greedy(large: list[tuple[int, int]], total: int, shares: tuple[tuple[str, float], ...]) -> tuple[dict[int, str], list[float]]:
    """A split for each of the ``large`` groups (id, size), by falling size: the one that lacks most. Also
    what each split then still lacks, as shares of the rest."""
    lack = [share * total for _, share in shares]
    given = {}
    for group, size in sorted(large, key=lambda x: (-x[1], x[0])):
        k = max(range(len(shares)), key=lambda i: (lack[i], -i))
        given[group] = shares[k][0]
        lack[k] -= size
    rest = [max(0.0, x) for x in lack]
    return given, [x / (sum(rest) or 1.0) for x in rest]


def deal(groups: DataFrame, shares: tuple[tuple[str, float], ...] = SPLITS, seed: int = 0) -> DataFrame:
    """(group_id, size, split) for ``groups`` (group_id, size).

    A band holds the sizes from one power of two to the next. Groups that hold more than 1/LARGE of the
    records, of which there are at most LARGE, are dealt one by one, the largest first, to the split that
    lacks most. In the bands below, groups are ordered by a seeded hash and dealt systematically: a turn of
    records holds each split's quota of what is still lacking, and the middle of a group decides in which it
    falls. Bands with many groups are dealt in buckets of about ROOTS_PER_TASK.
    """
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = [tuple(r) for r in groups.filter(F.col("size") * LARGE > total).select("group_id", "size").limit(LARGE).collect()]
    given, quotas = _greedy(large, total, shares)
    spark = groups.sparkSession
    first = F.broadcast(spark.createDataFrame(list(given.items()), f"group_id {dict(groups.dtypes)['group_id']}, split string"))
    dealt = groups.join(first, "group_id").select("group_id", "size", "split")
    rest = groups.filter(F.col("size") * LARGE <= total).withColumn("band", F.floor(F.log2("size")).cast("int"))
    counts = {r.band: r.g for r in rest.groupBy("band").agg(F.count(F.lit(1)).alias("g")).collect()}  # at most 64 bands
    if not counts:
        return dealt
    buckets = F.coalesce(*[F.when(F.col("band") == b, F.lit(-(-g // ROOTS_PER_TASK))) for b, g in counts.items()])
    order = W.partitionBy("band", "bucket").orderBy(F.xxhash64(F.lit(seed), "group_id"), "group_id")
    placed = rest.withColumn("bucket", F.pmod(F.xxhash64("group_id", F.lit(seed + 1)), buckets))
    turn = F.pow(F.lit(2.0), F.col("band")) * 15
    begin = F.pmod(F.xxhash64("band", "bucket", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    at = F.pmod((F.sum("size").over(order) - F.col("size") / 2) / turn + begin, F.lit(1.0))
    split, begins = F.lit(shares[0][0]), quotas[0]
    for (name, _), quota in zip(shares[1:], quotas[1:]):
        split = F.when((at >= begins) & (at < begins + quota), F.lit(name)).otherwise(split)
        begins += quota
    return dealt.unionByName(placed.select("group_id", "size", split.alias("split")))


def dataset_splits(dataset: DataFrame, shares: tuple[tuple[str, float], ...] = SPLITS, seed: int = 0) -> DataFrame:
    """(pair_id, group_id, split): a split for each pair; related pairs share one."""
    members = cut(dataset_groups(dataset)[1].members)
    dealt = deal(members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")), shares, seed)
    return lookup(members, dealt.select("group_id", "split"), "group_id").select(F.col("id").alias("pair_id"), "group_id", "split")
