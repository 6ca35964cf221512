"""Scores, weights and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_weight(freq: Column) -> Column:
    """1 + 2 / log2(freq + 1); a missing frequency counts as 1."""
    return 1 + 2 / F.log2(F.greatest(F.coalesce(freq, F.lit(1)), F.lit(1)) + 1)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def structural_score(wl: Column, ted: Column, match: Column, jaccard: Column) -> Column:
    """Weighted mean of the structural scores; ``ted`` is null where trees were too large for it."""
    return F.when(ted.isNotNull(), 0.15 * wl + 0.40 * ted + 0.30 * match + 0.15 * jaccard).otherwise(0.25 * wl + 0.50 * match + 0.25 * jaccard)


def size_ratio_ok(query: int, size: Column, ratio: float | None = None) -> Column:
    """Whether tree sizes are close enough to compare; the plain range lets row groups be skipped."""
    ratio = ratio or (1.2 if query < 600 else 1.8)
    low, high = int(query / ratio) - 1, int(query * ratio) + 1
    return size.between(low, high) & (F.greatest(F.lit(query), size) / F.greatest(F.least(F.lit(query), size), F.lit(1)) <= ratio)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def node_score(open_goals: Column, root_goals: int, depth: Column) -> Column:
    """Best-first score of a proof node: progress and shallowness."""
    progress = (root_goals - open_goals) / root_goals if root_goals else F.lit(1.0)
    return 0.7 * progress + 0.3 / (1 + depth)


def difficulty(steps: Column) -> Column:
    return F.when(steps <= 5, "short").when(steps <= 20, "medium").otherwise("long")


# Parts of a lower-cased module path and the domain they stand for, the first that occurs.
DOMAINS = {"arith": "arithmetic", "nat": "arithmetic", "zarith": "arithmetic", "algebra": "algebra", "ring": "algebra", "field": "algebra", "logic": "logic", "prop": "logic"}


def domain(path: Column) -> Column:
    return first_containing(F.lower(path), DOMAINS, "other")


def first_containing(text: Column, buckets: dict[str, str], default: str) -> Column:
    """The bucket of the first substring that ``text`` contains."""
    out = None
    for part, bucket in buckets.items():
        out = F.when(text.contains(part), bucket) if out is None else out.when(text.contains(part), bucket)
    return out.otherwise(default) if out is not None else F.lit(default)


# Seconds above which a sentence of each category is critical whatever the total.
CRITICAL = {"SlowQed": 10.0, "SlowReduction": 10.0, "TypeclassBlowup": 10.0, "HighSearchDepth": 5.0, "General": 30.0}


def bottleneck(kind: Column, snippet: Column, seconds: Column, total: Column) -> Column:
    """Category of a slow sentence by the first rule that holds; null if none does."""
    text = F.lower(snippet)
    depth = F.regexp_extract(snippet, r"eauto\s+(\d+)", 1).try_cast("int")
    return (
        F.when((kind == "ProofClose") & (seconds > 2) & (seconds > 5 * F.greatest(F.lit(0.0), total - seconds)), "SlowQed")
        .when((text.contains("simpl") | text.contains("cbn")) & (seconds > 2), "SlowReduction")
        .when(text.contains("typeclasses eauto") & (seconds > 2), "TypeclassBlowup")
        .when((depth > 6) & (seconds > 1), "HighSearchDepth")
        .when((text.contains("match goal") | text.contains("repeat")) & (seconds > 3), "ExpensiveMatch")
        .when(seconds > 5, "General")
    )


def severity(category: Column, seconds: Column, total: Column) -> Column:
    limit = F.create_map(*[F.lit(x) for pair in CRITICAL.items() for x in pair])[category]
    return F.when(category.isNull(), None).when((total > 0) & (seconds / total > 0.5), "critical").when(seconds > limit, "critical").otherwise("warning")
