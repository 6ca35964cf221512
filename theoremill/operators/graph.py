"""Dependency graphs: closures, impact, cycles, module roll-ups, subgraphs and strict cycles.

Traversals are level-synchronous: a level is one join of the frontier with the edges, reduced to distinct
nodes and anti-joined with what has been visited; each level is written to the shared folder, so plans stay
short. Edges are (src, dst); hot nodes go through salted joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from theoremill.functions.names import module_of
from theoremill.runtime import BROADCAST_ROWS, cut, hot_keys, lookup, release, salted_join


class ResultTooLarge(ValueError):
    """A closure holds more nodes than allowed."""


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without nulls and self loops."""
    return edges.filter("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = None, allowed: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(node, depth): nodes reachable from ``roots`` (node) and their least distance; roots have depth 0.

    ``depth`` bounds the distance (values below 1 count as 1); nodes that aren't in ``allowed`` (node) end
    the traversal; more than ``most`` nodes raise ResultTooLarge after the level that exceeds it.

    The edges are written once. A frontier of few nodes is broadcast to them, after it has been counted; a
    larger one is joined by shuffle, the hot nodes split off. Levels are appended, never written again but to
    keep the plan short.
    """
    depth = None if depth is None else max(1, depth)
    held = cut(edges.select(F.col("src").alias("node"), "dst"))
    seen = [cut(roots.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0)))]
    frontier, level, n = seen[0], 0, seen[0].count()
    total, hot = n, None
    while n and (depth is None or level < depth):
        level += 1
        if n <= BROADCAST_ROWS:
            ahead = held.join(F.broadcast(frontier.select("node")), "node")
        else:
            hot = hot_keys(held, "node") if hot is None else hot
            ahead = lookup(held, frontier.select("node"), "node", hot=hot)
        found = ahead.select(F.col("dst").alias("node")).distinct()
        if allowed is not None:
            found = found.join(allowed.select("node"), "node", "left_semi")
        before = reduce(DataFrame.unionByName, seen)
        frontier = cut(found.join(before.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        n = frontier.count()
        total += n
        if n:
            seen.append(frontier)
        if len(seen) > 8:
            seen = [cut(before.unionByName(frontier) if n else before)]
        if most is not None and total > most:
            raise ResultTooLarge(f"the closure holds more than {most} nodes")
    return reduce(DataFrame.unionByName, seen)


def impact(edges: DataFrame, roots: DataFrame, **options) -> DataFrame:
    """(node, depth): what depends on ``roots``, directly or not; takes the options of :func:`closure`."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots, **options)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def reachable_undirected(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth) over edges in both directions."""
    return closure(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), seeds)


def subgraph(edges: DataFrame, root: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """(node, depth): the first ``most`` nodes around ``root`` by distance, then id."""
    return closure(edges, root, depth).orderBy("depth", "node").limit(most)


def truncated(edges: DataFrame, root: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """(nodes, shown, hidden): how many nodes :func:`subgraph` has found, shows and leaves out."""
    n = closure(edges, root, depth).agg(F.count(F.lit(1)).alias("nodes"))
    return n.select("nodes", F.least("nodes", F.lit(most)).cast("long").alias("shown"), F.greatest(F.col("nodes") - most, F.lit(0)).cast("long").alias("hidden"))


def module_cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(module, component): modules that use each other in a circle. ``nodes``: node, module. Modules are
    numbered in the order of their names, so a component has the name of its first."""
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("module").alias(f"{end}_module"))
    pairs = salted_join(lookup(edges, of("src"), "src").select("dst", "src_module"), of("dst"), "dst").select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst")).filter("src <> dst").distinct()
    return components(pairs).withColumnRenamed("node", "module")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the strongly connected components of two or more nodes, by their smallest node.

    Edges outside cycles are trimmed; each node takes the smallest node that reaches it as its colour; the
    nodes of a colour that lead back to that node are its component; the rest goes round again.
    """
    rest, found = cut(clean_edges(edges)), None
    while True:
        for _ in range(3):
            rest = cut(rest.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        if rest.isEmpty():
            break
        colour = cut(rest.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            ahead = salted_join(rest.withColumnRenamed("src", "node"), colour, "node").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            following = cut(colour.join(ahead, "node", "left").select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") < F.col("colour")).alias("changed")))
            changed = not following.filter("changed").isEmpty()
            release(colour)
            colour = following.drop("changed")
            if not changed:
                break
        within = cut(
            salted_join(rest.withColumnRenamed("src", "node"), colour, "node")
            .withColumnRenamed("node", "src")
            .withColumnRenamed("colour", "c")
            .join(colour.withColumnRenamed("node", "dst"), "dst")
            .filter("c = colour")
            .select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        )
        own = cut(closure(within, colour.filter("node = colour").select("node")).select("node").join(colour, "node").withColumnRenamed("colour", "component"))
        found = own if found is None else cut(found.unionByName(own))
        rest = cut(rest.join(own.select(F.col("node").alias("src")), "src", "left_anti").join(own.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    return found.join(sizes, "component", "left_semi").select("node", "component")


def module_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(module, fan_in, fan_out, nodes): numbers of other modules that use each module and that it uses, and
    of its own nodes. ``nodes``: node, module."""
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("module").alias(f"{end}_module"))
    pairs = salted_join(edges.join(of("src"), "src").select("dst", "src_module"), of("dst"), "dst").select("src_module", "dst_module").distinct().filter("src_module <> dst_module")
    out = pairs.groupBy(F.col("src_module").alias("module")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = pairs.groupBy(F.col("dst_module").alias("module")).agg(F.count(F.lit(1)).alias("fan_in"))
    own = nodes.groupBy("module").agg(F.count(F.lit(1)).alias("nodes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(out, "module", "left").join(into, "module", "left").select("module", zero("fan_in"), zero("fan_out"), "nodes")


def with_module(nodes: DataFrame, name: str = "node") -> DataFrame:
    """``nodes`` with the module inferred from each name."""
    return nodes.withColumn("module", module_of(name))


def _on_cycles(constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The constraints (src, dst, kind) inside strongly connected components, and the strict ones from a node to itself."""
    both = constraints.select("src", "dst", "kind").unionByName(constraints.filter("kind = 'eq'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    edges = cut(both.distinct())
    member = cut(components(edges.select("src", "dst")))
    inside = cut(edges.filter("src <> dst").join(member.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(member.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").filter("a = b").select("src", "dst", "kind"))
    return inside, edges.filter("src = dst and kind = 'lt'").select("src", "dst", "kind")


def strict_cycles(constraints: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst, length): strict constraints (kind 'lt') that lie on a cycle, with the length of the
    shortest one; any row means the constraints contradict each other. 'le' leads on, 'eq' both ways.

    ``constraints``: src, dst, kind. Only edges inside strongly connected components are followed, until all
    are; with a ``depth``, longer cycles give no row, which then doesn't mean that there are none.
    """
    inside, loops = _on_cycles(constraints)
    starts = inside.filter("kind = 'lt'").select("src", "dst").distinct()
    seen = cut(starts.select("src", "dst", F.col("dst").alias("at"), F.lit(1).alias("length")))
    frontier, step = seen, 1
    while depth is None or step < depth:
        step += 1
        ahead = frontier.join(inside.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at").select("src", "dst", F.col("to").alias("at")).distinct()
        frontier = cut(ahead.join(seen.select("src", "dst", "at"), ["src", "dst", "at"], "left_anti").withColumn("length", F.lit(step)).select("src", "dst", "at", "length"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen.filter("at = src").select("src", "dst", "length").unionByName(loops.select("src", "dst", F.lit(1).alias("length")))


def compatible(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of constraints hold together: a strict one inside a strongly connected component is on a cycle."""
    inside, loops = _on_cycles(a.unionByName(b))
    return inside.filter("kind = 'lt'").isEmpty() and loops.isEmpty()


def scope(module: str | None = None, excluded: str | None = None, root_module: str | None = None) -> Column:
    """Which nodes a traversal may enter: a module prefix, none of an excluded one, the root's project."""
    keep = F.lit(True)
    if module is not None:
        keep = keep & F.col("module").startswith(module)
    if excluded is not None:
        keep = keep & (F.col("module").isNull() | ~F.col("module").startswith(excluded))
    if root_module is not None:
        keep = keep & (F.split("module", r"\.")[0] == root_module.split(".")[0])
    return keep
