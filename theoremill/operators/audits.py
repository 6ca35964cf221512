"""Assumption audits, set comparisons, version ranges, snapshots and merging of libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from theoremill.runtime import lookup, row_index

# Patterns of an axiom's type and what they mean, the first that holds.
AXIOM_TYPES = (
    (r"forall\s+\w+\s*:\s*Prop\s*,\s*\w+\s*\\/\s*~\s*\w+", "classical"),
    (r"forall\s+\w+\s*:\s*Prop\s*,\s*~\s*~\s*\w+\s*->\s*\w+", "classical"),
    (r"forall\s+.*,\s*\(forall\s+\w+\s*,\s*\w+\s+\w+\s*=\s*\w+\s+\w+\)\s*->\s*\w+\s*=\s*\w+", "extensionality"),
    (r"forall\s+.*Prop.*,\s*\w+\s*=\s*\w+\s*$", "proof_irrelevance"),
)


def axiom_category(name: Column, kind: Column, known: dict[str, str], prefixes: dict[str, str]) -> Column:
    """Category of an axiom: by its name, else its module's prefix, else the pattern of its type, else custom."""
    out = F.create_map(*[F.lit(x) for p in known.items() for x in p])[name] if known else F.lit(None).cast("string")
    rest = F.when(F.lit(False), "")
    for prefix, category in prefixes.items():
        rest = rest.when(name.startswith(f"{prefix}."), category)
    for pattern, category in AXIOM_TYPES:
        rest = rest.when(kind.rlike(pattern), category)
    return F.coalesce(out, rest.otherwise("custom"))


def axiom_usage(uses: DataFrame) -> DataFrame:
    """(axiom, theorems): how many theorems use each axiom; ``uses``: theorem, axiom."""
    return uses.filter("axiom is not null").groupBy("axiom").agg(F.count_distinct("theorem").alias("theorems"))


def compare_assumptions(uses: DataFrame, theorems: int) -> DataFrame:
    """(axiom, n, relation): shared by all compared theorems, unique to one, or in several."""
    counts = uses.groupBy("axiom").agg(F.count_distinct("theorem").alias("n"))
    return counts.withColumn("relation", F.when(F.col("n") == theorems, "shared").when(F.col("n") == 1, "unique").otherwise("several"))


def weakest(sets: DataFrame) -> DataFrame:
    """The theorems (theorem, axioms) that assume least: no other's axioms are a proper subset, then the
    fewest. A set that is a proper subset is smaller, so only the smallest sets can be both."""
    least = sets.agg(F.min(F.size("axioms")).alias("least"))
    return sets.crossJoin(F.broadcast(least)).filter(F.size("axioms") == F.col("least")).select("theorem", F.size("axioms").alias("n"))  # one row


def version_key(version: str | Column) -> Column:
    """A string that sorts like the version: numeric segments by value, '~' in front of the end of the text,
    '+' behind it."""
    parts = F.regexp_extract_all(version, F.lit(r"(\d+|[A-Za-z]+|[~+])"), F.lit(1))
    coded = F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("4"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0"))).when(p == "~", "0").when(p == "+", "2").otherwise(F.concat(F.lit("3"), p, F.lit(" "))))
    return F.concat(F.array_join(coded, ""), F.lit("1"))


def in_range(key: Column, low: Column, low_in: Column, high: Column, high_in: Column) -> Column:
    """Whether a sort key lies in an interval whose ends may be null (open)."""
    above = low.isNull() | (key > low) | (low_in & (key == low))
    below = high.isNull() | (key < high) | (high_in & (key == high))
    return above & below


def version_ranges(constraints: DataFrame, resource: str) -> DataFrame:
    """(resource, low, high, n, conflict): intersection of all intervals (low, high; inclusive, null is open)
    on each resource; an empty one is a conflict if at least two constraints made it."""
    sums = constraints.groupBy(resource).agg(F.max("low").alias("low"), F.min("high").alias("high"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("conflict", (F.col("n") > 1) & F.coalesce(F.col("low") > F.col("high"), F.lit(False)))


def relaxations(constraints: DataFrame, resource: str, edge: str) -> DataFrame:
    """(resource, edge): constraints without which the others on a conflicting resource agree.

    The greatest and second greatest lower bounds (and least upper ones) tell what is left without any one
    constraint, so no constraint is paired with another."""
    ranked = constraints.groupBy(resource).agg(F.max("low").alias("l1"), F.min("high").alias("h1"))
    tops = constraints.join(ranked, resource)
    second = tops.groupBy(resource).agg(F.max(F.when(F.col("low") < F.col("l1"), F.col("low"))).alias("l2"), F.min(F.when(F.col("high") > F.col("h1"), F.col("high"))).alias("h2"), F.sum(F.when(F.col("low") == F.col("l1"), 1).otherwise(0)).alias("ln"), F.sum(F.when(F.col("high") == F.col("h1"), 1).otherwise(0)).alias("hn"))
    each = tops.join(second, resource).filter("l1 > h1")
    rest_low = F.when((F.col("low") == F.col("l1")) & (F.col("ln") == 1), F.col("l2")).otherwise(F.col("l1"))
    rest_high = F.when((F.col("high") == F.col("h1")) & (F.col("hn") == 1), F.col("h2")).otherwise(F.col("h1"))
    return each.filter(F.coalesce(rest_low <= rest_high, F.lit(True))).select(resource, edge)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, status): new, removed, changed or unchanged."""
    both = before.select(key, F.col(value).alias("before"), F.lit(1).alias("_b")).join(after.select(key, F.col(value).alias("after"), F.lit(1).alias("_a")), key, "full_outer")
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed")
    return both.select(key, "before", "after", status.alias("status"))


class DuplicateNames(ValueError):
    """Two libraries declare the same name."""


def merge_declarations(libraries: DataFrame, on_duplicate: str = "first") -> DataFrame:
    """(library, old_id, id, name): all declarations with new ids from 1, ordered by library, then name.

    ``libraries``: library, id, name. Of a name in several libraries the first library's holds, or
    DuplicateNames is raised with ``on_duplicate='raise'``.
    """
    first = libraries.groupBy("name").agg(F.min(F.struct("library", "id")).alias("m"), F.count(F.lit(1)).alias("n"))
    if on_duplicate == "raise" and not first.filter("n > 1").isEmpty():
        raise DuplicateNames("a name is declared twice")
    kept = first.select("m.library", F.col("m.id").alias("old_id"), "name")
    return row_index(kept, ["library", "name"]).select("library", "old_id", (F.col("index") + 1).alias("id"), "name")


def merge_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """(src, dst, relation) under the new ids; ``edges``: library, src, dst, relation. Edges with an end that
    wasn't kept are dropped, and so are self loops and repeated ones."""
    named = lambda old: F.concat_ws("\x1f", F.col("library").cast("string"), F.col(old).cast("string"))
    ids = lambda end: merged.select(named("old_id").alias(end), F.col("id").alias(f"new_{end}"))
    moved = lookup(edges.filter("src is not null and dst is not null").select(named("src").alias("src"), named("dst").alias("dst"), "relation"), ids("src"), "src")
    moved = lookup(moved, ids("dst"), "dst")
    return moved.filter("new_src <> new_dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "relation").distinct()
