"""Symbol sets: inverted index, resolution of partial names, weighted relevance and iterative selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from theoremill.functions.names import STANDARD, alias_symbol, suffixes
from theoremill.functions.scores import symbol_weight
from theoremill.runtime import BROADCAST_ROWS, cut, lookup, strip

# Operators and the names they are indexed by.
OPERATORS = {"+": "Nat.add", "*": "Nat.mul", "-": "Nat.sub"}

_ARRAY = r"(?s)^\s*\[.*\]\s*$"


def symbol_array(json: str | Column) -> Column:
    """Distinct, stripped symbols of a JSON array; empty for null and for what is no well-formed array."""
    parsed = F.when(F.col(json).rlike(_ARRAY) if isinstance(json, str) else json.rlike(_ARRAY), F.from_json(json, "array<string>", {"allowSingleQuotes": "false"}))
    return F.array_distinct(F.filter(F.transform(F.coalesce(parsed, F.array().cast("array<string>")), strip), lambda s: s.isNotNull() & (s != "")))


def postings(declarations: DataFrame, symbols: str = "symbols") -> DataFrame:
    """(symbol, id): the inverted index in rows."""
    return declarations.select("id", F.explode(symbols).alias("symbol"))


def frequencies(index: DataFrame) -> DataFrame:
    """(symbol, freq): in how many declarations each symbol occurs."""
    return index.groupBy("symbol").agg(F.count(F.lit(1)).alias("freq"))


def suffix_table(symbols: DataFrame) -> DataFrame:
    """(suffix, symbol) for every proper dot-suffix of every symbol."""
    return symbols.select("symbol", F.explode(suffixes("symbol")).alias("suffix"))


def resolve_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, symbol): each name's one match, exact, else under the standard prefix, else by a suffix that
    only one symbol has; null if none. Names are joined, never collected."""
    exact = known.select(F.col("symbol").alias("name"), F.col("symbol").alias("exact"))
    standard = known.filter(F.col("symbol").startswith(STANDARD)).select(F.substring("symbol", len(STANDARD) + 1, 1 << 30).alias("name"), F.col("symbol").alias("standard"))
    unique = suffix_table(known).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("by_suffix")).filter("n = 1").select(F.col("suffix").alias("name"), "by_suffix")
    return names.select("name").distinct().join(exact, "name", "left").join(standard, "name", "left").join(unique, "name", "left").select("name", F.coalesce("exact", "standard", "by_suffix").alias("symbol"))


def resolve_query(symbols: Sequence[str], known: DataFrame) -> DataFrame:
    """(input, symbol): all symbols each query symbol stands for: itself, its new name, an operator's name,
    and every symbol it is a dot-suffix of; itself where nothing is known. The query is a short literal list."""
    named = [(s, OPERATORS.get(s, s)) for s in dict.fromkeys(symbols)]
    spark = known.sparkSession
    wanted = F.broadcast(spark.createDataFrame(named or [("", "")], "input string, name string").withColumn("name", alias_symbol(F.col("name"))).filter("input <> ''"))
    exact = known.join(wanted, known.symbol == wanted.name).select("input", "symbol")
    partial = suffix_table(known).join(wanted, F.col("suffix") == F.col("name")).select("input", "symbol")
    found = exact.unionByName(partial).distinct()
    rest = wanted.join(found.select("input").distinct(), "input", "left_anti").select("input", F.col("name").alias("symbol"))
    return found.unionByName(rest)


def weigh(index: DataFrame) -> DataFrame:
    """(symbol, id, w, y): the inverted index with each symbol's weight and the sum of the weights of its
    declaration; made once, it serves every round of every selection."""
    weighted = cut(lookup(index, frequencies(index), "symbol").select("symbol", "id", symbol_weight(F.col("freq")).alias("w")))
    return weighted.join(weighted.groupBy("id").agg(F.sum("w").alias("y")), "id").select("symbol", "id", "w", "y")


def select_weighted(weights: DataFrame, symbols: DataFrame, p: float = 0.6, c: float = 2.4, rounds: int = 5) -> DataFrame:
    """(id, relevance, round): iterative selection. Each round takes the declarations whose relevance, the
    weight of their chosen symbols over that of all, reaches p / c^round, then chooses their symbols too. At
    most ``rounds`` rounds; empty symbols give none.

    A round reads the postings of the symbols chosen last and adds them to the running sums, so only
    declarations that share a chosen symbol are ever weighed.
    """
    fresh = cut(symbols.select("symbol").distinct())
    chosen, sums, selected, threshold = fresh, None, None, p
    for k in range(rounds):
        hits = _matching(weights, fresh).groupBy("id", "y").agg(F.sum("w").alias("x"))
        sums = cut(hits if sums is None else sums.unionByName(hits.select("id", "y", "x")).groupBy("id", "y").agg(F.sum("x").alias("x")), replaces=sums)
        near = sums.select("id", (F.col("x") / F.col("y")).alias("relevance")).filter(F.col("relevance") >= threshold)
        if selected is not None:
            near = near.join(selected.select("id"), "id", "left_anti")
        batch = cut(near.withColumn("round", F.lit(k + 1)))
        if batch.isEmpty():
            break
        selected = batch if selected is None else cut(selected.unionByName(batch))
        if k + 1 < rounds:
            n = batch.count()
            side = F.broadcast(batch.select("id")) if n <= BROADCAST_ROWS else batch.select("id")
            fresh = cut(weights.join(side, "id", "left_semi").select("symbol").distinct().join(chosen, "symbol", "left_anti"))
            chosen = cut(chosen.unionByName(fresh))
            threshold /= c
    return selected if selected is not None else weights.select("id", F.lit(0.0).alias("relevance"), F.lit(0).alias("round")).limit(0)


def _matching(weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """The postings of the ``chosen`` symbols, few of them broadcast after they have been counted."""
    n = chosen.count()
    if n <= BROADCAST_ROWS:
        return weights.join(F.broadcast(chosen.select("symbol")), "symbol", "left_semi")
    return lookup(weights, chosen.select("symbol"), "symbol")


def select_relevant(index: DataFrame, freq: DataFrame, symbols: DataFrame, p: float = 0.6, c: float = 2.4, rounds: int = 5) -> DataFrame:
    """:func:`select_weighted` over an inverted index (symbol, id) with given frequencies (symbol, freq)."""
    weighted = cut(lookup(index, freq, "symbol").select("symbol", "id", symbol_weight(F.col("freq")).alias("w")))
    return select_weighted(cut(weighted.join(weighted.groupBy("id").agg(F.sum("w").alias("y")), "id").select("symbol", "id", "w", "y")), symbols, p, c, rounds)


def search_by_symbols(declarations: DataFrame, symbols: Sequence[str], limit: int = 50, weights: DataFrame | None = None) -> DataFrame:
    """(id, relevance): the selected declarations that hold at least one symbol of every query symbol;
    ``weights``: what :func:`weigh` gives for them, if it is written already."""
    weights = cut(weigh(postings(declarations))) if weights is None else weights
    groups = cut(resolve_query(symbols, weights.select("symbol").distinct()))
    picked = select_weighted(weights, groups)
    n = len(dict.fromkeys(symbols))
    full = weights.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "symbol").groupBy("id").agg(F.count_distinct("input").alias("n")).filter(F.col("n") == n).select("id")
    return picked.join(full, "id", "left_semi").select("id", F.round("relevance", 6).alias("relevance")).orderBy(F.desc("relevance"), "id").limit(limit)


def jaccard(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, jaccard) of the declarations of an inverted index that share a symbol with ``wanted`` (symbol)."""
    n = wanted.count()
    shared = _matching(index, wanted).groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    sizes = index.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    return shared.join(sizes, "id").select("id", F.round(F.col("shared") / (F.col("size") + n - F.col("shared")), 6).alias("jaccard"))


def jaccard_ranking(declarations: DataFrame, symbols: Sequence[str], limit: int | None = 50) -> DataFrame:
    """(id, score): Jaccard similarity of each declaration's symbols with ``symbols``, of those that share any."""
    wanted = F.array(*map(F.lit, dict.fromkeys(symbols))) if symbols else F.array().cast("array<string>")
    shared = F.size(F.array_intersect("symbols", wanted))
    union = F.size(F.array_union("symbols", wanted))
    scored = declarations.filter(shared > 0).select("id", F.round(shared / union, 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit) if limit else scored


def rank(rows: DataFrame, score: str = "score", key: str = "id", channel: str | None = None) -> DataFrame:
    """``rows`` with their 1-based rank by falling score, ties by key, within each channel if one is named."""
    order = W.partitionBy(*([channel] if channel else [])).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(order))
