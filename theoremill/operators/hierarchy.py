"""Parent–child rows to full hierarchies: path, depth, root, descendants and cycles.

Every node has at most one parent, so the graph is a forest in which some components end in a cycle.

1. *Pointer doubling* finds, in about log2(depth) rounds, each node's root. The same rounds add up the
   subtree sizes. A round in which no node reaches its root proves that the rest lead into cycles.
2. *Cycle separation*: the repeated image of those nodes shrinks to exactly the nodes on cycles, whose
   smallest id is carried round by doubling.
3. *Heavy-path decomposition*: the child with the largest subtree continues its parent's chain. Nodes
   get (chain, position); a path crosses at most log2(n) chains, so roots, depths, paths and pre-order
   intervals follow from doubling over the much smaller table of chains.

A node's descendants are the nodes of its root whose ``lo`` lies in (lo, hi); a chain is a contiguous
interval of the same numbering. All tables are hash-partitioned by node; hot parents go through
:func:`theoremill.runtime.lookup` and sums are combined before they are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from theoremill.runtime import cut, lookup, strip

#: Siblings whose running sum one task computes.
SIBLINGS_PER_TASK = 50_000
#: Pre-order numbers of a block, and how many times longer the blocks of the next level are.
SPAN = 64


@dataclass
class Hierarchy:
    """``nodes``: node, parent, root, depth, kind ('tree', 'cycle', 'into_cycle'), size, chain, pos; with
    intervals also lo and hi; with segments also the pieces of chains that make up the path from the root, each
    with its chain (named by its head) and the last position taken, at most log2(n) of them; with paths also
    path (ids from the root to the node), as long as the node is deep."""

    nodes: DataFrame

    def cycles(self) -> DataFrame:
        """One row per cycle: its smallest id, its length and the number of nodes that lead into it."""
        return (
            self.nodes.filter("kind <> 'tree'")
            .groupBy(F.col("root").alias("cycle_id"))
            .agg(
                F.sum(F.when(F.col("kind") == "cycle", 1).otherwise(0)).alias("length"),
                F.sum(F.when(F.col("kind") == "into_cycle", 1).otherwise(0)).alias("leading_in"),
            )
        )

    def descendants(self, of: DataFrame | None = None) -> DataFrame:
        """(ancestor, descendant, distance) for every ancestor, or for those listed in ``of`` (node).

        Needs ``intervals=True``. An ancestor's descendants are an interval of the pre-order numbers of its
        tree. Numbers are cut into blocks of SPAN^k, k by the interval's length, so that an ancestor asks at
        most SPAN^2 + 2 blocks and meets few others than its own; no group is ever gathered.
        """
        tree = cut(self.nodes.filter("kind = 'tree'").select("node", "root", "depth", "size", "lo", "hi"))
        most = tree.agg(F.max("size")).first()[0] or 1
        levels = max(1, int(math.log(most, SPAN)) - 1)
        above = tree.filter("size > 1")
        if of is not None:
            above = above.join(of.select("node").distinct(), "node", "left_semi")
        level = F.greatest(F.lit(1), F.least(F.lit(levels), F.floor(F.log(float(SPAN), F.col("size"))) - 1)).cast("int")
        width = F.pow(F.lit(SPAN), "level").cast("long")
        asks = above.withColumn("level", level).select(
            F.col("node").alias("ancestor"), "root", "level", F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("depth").alias("above"),
            F.explode(F.sequence(F.floor((F.col("lo") + 1) / width), F.floor((F.col("hi") - 1) / width))).alias("block"),
        )
        below = tree.filter("depth > 0").select(F.col("node").alias("descendant"), "root", "depth", "lo", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"))
        below = below.withColumn("block", F.floor(F.col("lo") / width))
        return asks.join(below, ["root", "level", "block"]).filter(F.col("lo").between(F.col("from") + 1, F.col("to") - 1)).select("ancestor", "descendant", (F.col("depth") - F.col("above")).alias("distance"))

    def paths(self) -> DataFrame:
        """(node, path): ids from the root to each node of a tree, the node last; needs ``intervals=True``. What
        is gathered for a node is its own path, no more."""
        own = self.nodes.filter("kind = 'tree'").select(F.col("node").alias("ancestor"), F.col("node").alias("descendant"), F.lit(0).cast("long").alias("distance"))
        steps = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor")))
        return self.descendants().unionByName(own).groupBy(F.col("descendant").alias("node")).agg(steps.alias("s")).select("node", F.col("s.ancestor").alias("path"))


def parent_edges(rows: DataFrame, relation: str = "instance_of") -> DataFrame:
    """(node, parent), one row per node, of the ``relation`` rows of a dependency table.

    Case and blanks around the relation are disregarded; rows with a null end or src = dst are left out;
    of several rows of one src the latest extracted_at holds (null is oldest; of equal ones the smallest
    dst).
    """
    return (
        rows.filter((F.lower(strip("relation")) == relation) & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .groupBy(F.col("src").cast("long").alias("node"))
        .agg(F.max(F.struct("extracted_at", (-F.col("dst").cast("long")).alias("neg"))).alias("m"))
        .select("node", (-F.col("m.neg")).alias("parent"))
    )


def double_pointers(state: DataFrame, sums: tuple[str, ...] = (), arrays: tuple[str, ...] = (), count_below: bool = False) -> tuple[DataFrame, int]:
    """Pointer doubling over (node, top, dist, ...): ``top`` is the ancestor ``dist`` steps up, a root has
    top = node and dist = 0. Columns in ``sums`` / ``arrays`` are added up / put in front along the way.
    ``count_below`` keeps ``size``, the number of nodes below and including each.

    Returns the final state and the step k: nodes with dist = 2^k still lead on (into a cycle).
    """
    step, active = 1, state.filter(F.col("dist") == 1).count()
    while active:
        going = state.filter(F.col("dist") == step)
        carried = [*sums, *arrays]
        target = state.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("dist").alias("_dist"), *[F.col(c).alias(f"_{c}") for c in carried])
        moved = lookup(going.select("node", "top", *carried), target, "top", total=active).select(
            "node",
            F.col("_top").alias("_new"),
            F.col("_dist").alias("_more"),
            *[(F.col(c) + F.col(f"_{c}")).alias(f"_{c}") for c in sums],
            *[F.concat(f"_{c}", c).alias(f"_{c}") for c in arrays],
        )
        following = state.join(moved, "node", "left")
        if count_below:
            following = following.join(going.groupBy(F.col("top").alias("node")).agg(F.sum("size").alias("_add")), "node", "left")
        old = {"top": F.coalesce("_new", "top"), "dist": F.col("dist") + F.coalesce("_more", F.lit(0))}
        old |= {c: F.coalesce(f"_{c}", c) for c in carried}
        if count_below:
            old["size"] = F.col("size") + F.coalesce("_add", F.lit(0))
        state = cut(following.select(*[old.get(c, F.col(c)).alias(c) for c in state.columns]), replaces=state)
        step *= 2
        left = state.filter(F.col("dist") == step).count()
        if left == active:
            return state, step
        active = left
    return state, step


def _cycles(going: DataFrame) -> DataFrame:
    """(node, root, on_cycle) of nodes none of which leads to a root; ``going``: node, parent, top."""
    jumps, size, count = going.select("node", "top"), -1, going.count()
    while True:
        image = cut(jumps.select(F.col("top").alias("node")).distinct())
        n = image.count()
        if n == size or n == 0:
            break
        size = n
        jumps = cut(lookup(jumps, jumps.select(F.col("node").alias("top"), F.col("top").alias("_top")), "top", total=count).select("node", F.col("_top").alias("top")))
    ring = cut(going.join(image, "node", "left_semi").select("node", F.col("parent").alias("ptr"), F.col("node").alias("least")))
    while n:
        ahead = ring.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("least").alias("_least"))
        ring = cut(
            ring.join(ahead, "ptr").select(
                "node", F.col("_ptr").alias("ptr"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("changed")
            )
        )
        if ring.filter("changed").isEmpty():
            break
        ring = ring.drop("changed")
    least = ring.select(F.col("node").alias("top"), F.col("least").alias("root"))
    on = image.withColumn("on_cycle", F.lit(True))
    return lookup(jumps, least, "top", total=count).select("node", "root").join(on, "node", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))


def _light_offsets(light: DataFrame) -> DataFrame:
    """(node, before): total size of the light siblings in front of each. ``light``: node, parent, size.

    A parent may have a third of all nodes as children, so running sums are taken within buckets of about
    SIBLINGS_PER_TASK siblings and shifted by the sums of the buckets in front.
    """
    counts = light.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    buckets = F.ceil(F.col("n") / SIBLINGS_PER_TASK)
    placed = lookup(light, counts, "parent").withColumn("bucket", F.pmod(F.xxhash64("node"), buckets))
    within = placed.withColumn("inner", F.sum("size").over(W.partitionBy("parent", "bucket").orderBy("node")) - F.col("size"))
    ahead = placed.groupBy("parent", "bucket").agg(F.sum("size").alias("s"))
    ahead = ahead.withColumn("outer", F.sum("s").over(W.partitionBy("parent").orderBy("bucket")) - F.col("s")).select("parent", "bucket", "outer")
    return within.join(ahead, ["parent", "bucket"]).select("node", (F.col("inner") + F.col("outer")).alias("before"))


def hierarchy(edges: DataFrame, intervals: bool = False, paths: bool = False, segments: bool = False) -> Hierarchy:
    """Full hierarchies of ``edges`` (node, parent): one row for each id at either end of an edge.

    A root has itself as root and depth 0; a node on a cycle the cycle's smallest id and depth -1; a node
    that leads into a cycle the same root and depth -2 (size, chain and pos are null for both). Rows with a
    null end or node = parent are ignored; of several parents of a node the smallest holds; an empty table
    gives an empty result; columns besides the two are ignored.
    """
    intervals = intervals or paths
    edges = (
        edges.filter("node is not null and parent is not null and node <> parent")
        .groupBy(F.col("node").cast("long").alias("node"))
        .agg(F.min(F.col("parent").cast("long")).alias("parent"))
    )
    start = cut(
        edges.select("node", "parent")
        .unionByName(edges.select(F.col("parent").alias("node"), F.lit(None).cast("long").alias("parent")))
        .groupBy("node")
        .agg(F.max("parent").alias("parent"))
        .select("node", "parent", F.coalesce("parent", "node").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("size"))
    )
    state, step = double_pointers(start, count_below=True)
    tree, looping = state.filter(F.col("dist") < step), state.filter(F.col("dist") == step)

    # Chains: each node follows its parent as long as it is the heavy child.
    heavy = (
        tree.filter("parent is not null")
        .groupBy("parent")
        .agg(F.max(F.struct("size", (-F.col("node")).alias("neg"))).alias("m"))
        .select((-F.col("m.neg")).alias("node"), F.lit(True).alias("heavy"))
    )
    marked = tree.select("node", "parent", "size").join(heavy, "node", "left")
    up = F.col("heavy").isNotNull()
    chained = cut(marked.select("node", "parent", "size", F.when(up, F.col("parent")).otherwise(F.col("node")).alias("top"), F.when(up, 1).otherwise(0).cast("long").alias("dist")))
    chained = double_pointers(chained)[0].select("node", "parent", "size", F.col("top").alias("chain"), F.col("dist").alias("pos"))

    chains = _chains(chained, intervals, segments)
    full = lookup(chained, chains, "chain")
    columns = {
        "node": F.col("node"),
        "parent": F.col("parent"),
        "root": F.col("_root"),
        "depth": F.col("_depth") + F.col("pos"),
        "kind": F.lit("tree"),
        "size": F.col("size"),
        "chain": F.col("chain"),
        "pos": F.col("pos"),
    }
    if intervals:
        columns |= {"lo": F.col("_lo") + F.col("pos"), "hi": F.col("_lo") + F.col("pos") + F.col("size")}
    if segments:
        columns["segments"] = F.concat("_prefix", F.array(F.struct("chain", F.col("pos").alias("upto"))))
    nodes = full.select(*[c.alias(k) for k, c in columns.items()])
    if not looping.isEmpty():
        rest = _cycles(looping).join(looping.select("node", "parent"), "node")
        known: dict[str, Column] = {
            "node": F.col("node"),
            "parent": F.col("parent"),
            "root": F.col("root"),
            "depth": F.when(F.col("on_cycle"), -1).otherwise(-2).cast("long"),
            "kind": F.when(F.col("on_cycle"), "cycle").otherwise("into_cycle"),
        }
        types = dict(nodes.dtypes)
        nodes = nodes.unionByName(rest.select(*[known.get(c, F.lit(None).cast(types[c])).alias(c) for c in nodes.columns]))
    if paths:
        nodes = cut(nodes)
        nodes = nodes.join(Hierarchy(nodes).paths(), "node", "left")
    return Hierarchy(nodes)


def _chains(chained: DataFrame, intervals: bool, segments: bool) -> DataFrame:
    """(chain, _root, _depth[, _lo][, _prefix]): what the head of each chain has.

    Doubling over the tree of chains, which is at most log2(n) deep.
    """
    heads = chained.filter("pos = 0").select(F.col("chain").alias("node"), "parent", "size")
    parents = chained.select(F.col("node").alias("parent"), F.col("chain").alias("above"), F.col("pos").alias("ppos"), F.col("size").alias("psize"))
    light = lookup(heads.filter("parent is not null"), parents, "parent")
    if intervals:
        # A parent's own number comes first, then its heavy child's subtree, then the light ones in turn.
        light_sum = light.groupBy("parent").agg(F.sum("size").alias("lights"))
        before = _light_offsets(light.select("node", "parent", "size"))
        light = lookup(light, light_sum, "parent").join(before, "node")
        shift = F.col("ppos") + F.col("psize") - F.col("lights") + F.col("before")
    columns = ["node", F.col("above").alias("top"), F.lit(1).cast("long").alias("dist"), (F.col("ppos") + 1).alias("depth")]
    roots = ["node", F.col("node").alias("top"), F.lit(0).cast("long").alias("dist"), F.lit(0).cast("long").alias("depth")]
    if intervals:
        columns.append(shift.alias("lo"))
        roots.append(F.lit(0).cast("long").alias("lo"))
    top = heads.filter("parent is null")
    if segments:
        columns.append(F.array(F.struct(F.col("above").alias("chain"), F.col("ppos").alias("upto"))).alias("prefix"))
        roots.append(F.array().cast("array<struct<chain:bigint,upto:bigint>>").alias("prefix"))
    state = double_pointers(cut(light.select(*columns).unionByName(top.select(*roots))), sums=("depth", "lo") if intervals else ("depth",), arrays=("prefix",) if segments else ())[0]
    return state.select(F.col("node").alias("chain"), F.col("top").alias("_root"), F.col("depth").alias("_depth"), *[F.col(c).alias(f"_{c}") for c in ("lo", "prefix") if c in state.columns])
