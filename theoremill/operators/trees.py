"""Structural search over expression trees: parsing, tree kernel screening, re-ranking, search by type.

Weisfeiler–Lehman histograms of a node table take one shuffle: nodes meet by tree and are labelled in one
pass over each, but for trees too large for a task, whose rounds are joins. The trees of type expressions are
rows, so their index (size, nodes, histogram) is made where they are parsed, without any shuffle; a search is a
scan of that index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.functions import trees as tree_functions
from theoremill.functions.scores import clamp, size_ratio_ok, structural_score
from theoremill.functions.texts import question_terms, type_terms
from theoremill.functions.trees import Tree, parse
from theoremill.operators import fusion, search, symbols
from theoremill.runtime import BROADCAST_ROWS, cut

#: Candidates of the screen, and the largest trees that are compared by edit distance.
SCREENED, EDIT_NODES = 500, 50
ROUNDS = 3
#: Nodes of a tree that one task may hold.
TASK_NODES = 200_000

_NODES = "array<struct<node:int,parent:int,tag:string,payload:string,depth:int,children:int>>"


def rows_of(tree: Tree) -> list[dict]:
    """A tree as rows of nodes in pre-order."""
    parent, depth = [-1] * len(tree), [0] * len(tree)
    for i, below in enumerate(tree.children):
        for c in below:
            parent[c], depth[c] = i, depth[i] + 1
    return [{"node": i, "parent": parent[i], "tag": tree.tags[i], "payload": tree.payloads[i], "depth": depth[i], "children": len(tree.children[i])} for i in range(len(tree))]


def tree_of(rows: list[dict]) -> Tree:
    out = Tree([r["tag"] for r in rows], [r["payload"] for r in rows], [[] for _ in rows])
    for r in rows:
        if r["parent"] >= 0:
            out.children[r["parent"]].append(r["node"])
    return out


def parse_types(rows: DataFrame, key: str = "id", expression: str = "type_expr") -> DataFrame:
    """(key, nodes): trees of the type expressions that can be parsed; others, and nulls, give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("payload", pa.string()), ("depth", pa.int32()), ("children", pa.int32())]))
        for batch in batches:
            found = [(i, rows_of(t)) for i, text in enumerate(batch.column(1).to_pylist()) if (t := parse(text)) is not None]
            at = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([r for _, r in found], kind)], ["key", "nodes"])

    types = dict(rows.dtypes)
    return rows.filter(F.col(expression).isNotNull()).select(key, expression).mapInArrow(run, f"key {types[key]}, nodes {_NODES}").withColumnRenamed("key", key)


def node_table(trees: DataFrame, key: str = "id") -> DataFrame:
    """(tree, node, parent, tag, depth, children) from (key, nodes)."""
    return trees.select(F.col(key).alias("tree"), F.inline("nodes")).select("tree", "node", F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"), "tag", "depth", "children")


def wl_histograms(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(tree, label, n): how often each label occurs in all rounds together. Label 0 hashes a node's tag,
    depth and number of children; the next its label and the sorted labels of its children; names don't count.

    ``nodes`` has tree, node, parent, tag, depth and children; a tree of more than TASK_NODES nodes is labelled
    by joins, all others tree by tree.
    """
    counts = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    large = cut(counts.filter(F.col("n") > TASK_NODES).select("tree"))
    columns = ["tree", "node", "parent", "tag", F.col("depth").cast("int").alias("depth"), F.col("children").cast("int").alias("children")]
    if large.isEmpty():
        return _labelled_by_tree(nodes.select(*columns), rounds)
    side = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    small = nodes.filter("tree is not null").join(side, "tree", "left_anti").select(*columns)
    return _labelled_by_tree(small, rounds).unionByName(_labelled_by_joins(nodes.join(side, "tree", "left_semi").select(*columns), rounds))


def _labelled_by_tree(nodes: DataFrame, rounds: int) -> DataFrame:
    """Every tree's nodes meet in one task, which holds one tree at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("node", "parent", "tag", "depth")

        def done(tree, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            node, parent, tags, depths = ([x for b in held for x in b.column(c).to_pylist()] for c in columns)
            place = {n: k for k, n in enumerate(node)}
            below: list[list[int]] = [[] for _ in node]
            for k, p in enumerate(parent):
                if p is not None and p in place:
                    below[place[p]].append(k)
            counts = tree_functions.wl_labels(tags, depths, below, rounds)
            return pa.RecordBatch.from_arrays([pa.array([tree] * len(counts), kind), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["tree", "label", "n"])

        tree, held, kind = None, [], None
        for batch in batches:
            kind = batch.schema.field("tree").type
            trees = batch.column("tree").to_pylist()
            edges = [0, *[k for k in range(1, len(trees)) if trees[k] != trees[k - 1]], len(trees)]
            for s, e in zip(edges, edges[1:]):
                if s < e:
                    if held and trees[s] != tree:
                        yield done(tree, held)
                        held = []
                    tree = trees[s]
                    held.append(batch.slice(s, e - s))
        if held:
            yield done(tree, held)

    kind = nodes.schema["tree"].dataType.simpleString()
    return nodes.filter("tree is not null").repartition("tree").sortWithinPartitions("tree").mapInArrow(run, f"tree {kind}, label string, n long")


def _labelled_by_joins(nodes: DataFrame, rounds: int) -> DataFrame:
    first = F.md5(F.concat_ws("_", "tag", F.col("depth").cast("string"), F.col("children").cast("string")))
    labels = cut(nodes.select("tree", "node", "parent", first.alias("label")))
    every = labels.select("tree", "label")
    for _ in range(rounds):
        below = labels.filter("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("label")), "").alias("below"))
        labels = cut(labels.join(below, ["tree", "node"], "left").select("tree", "node", "parent", F.md5(F.concat("label", F.coalesce("below", F.lit("")))).alias("label")))
        every = every.unionByName(labels.select("tree", "label"))
    return every.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n"))


def type_index(rows: DataFrame, key: str = "id", expression: str = "type_expr") -> DataFrame:
    """(key, size, nodes, histogram, norm) of the type expressions that can be parsed; others, and nulls, give no
    row. One pass, nothing is shuffled; written once, it serves any number of searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("payload", pa.string()), ("depth", pa.int32()), ("children", pa.int32())]))
        for batch in batches:
            found = [(i, t) for i, text in enumerate(batch.column(1).to_pylist()) if (t := parse(text)) is not None]
            nodes = [rows_of(t) for _, t in found]
            counts = [tree_functions.wl_labels(t.tags, [r["depth"] for r in n], t.children, ROUNDS) for (_, t), n in zip(found, nodes)]
            norms = [math.sqrt(sum(n * n for n in c.values())) for c in counts]
            columns = [batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([len(t) for _, t in found], pa.int32()), pa.array(nodes, kind), pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64())), pa.array(norms, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "size", "nodes", "histogram", "norm"])

    types = dict(rows.dtypes)
    return rows.filter(F.col(expression).isNotNull()).select(key, expression).mapInArrow(run, f"key {types[key]}, size int, nodes {_NODES}, histogram map<string,bigint>, norm double").withColumnRenamed("key", key)


def wl_screen(histograms: DataFrame, sizes: DataFrame, query: DataFrame, query_size: int, n: int = SCREENED, ratio: float | None = None) -> DataFrame:
    """(tree, wl): the ``n`` trees of similar size whose histograms are most similar by cosine.

    ``query``: (label, n) of one tree, so a small side whatever the collection; ``sizes``: tree, size.
    """
    near = histograms.join(sizes.filter(size_ratio_ok(query_size, F.col("size"), ratio)).select("tree"), "tree", "left_semi")
    norms = near.groupBy("tree").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    own = query.agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("own"))
    dots = near.join(F.broadcast(query.select("label", F.col("n").alias("m"))), "label").groupBy("tree").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))  # one tree
    scored = dots.join(norms, "tree").crossJoin(F.broadcast(own)).select("tree", F.round(F.col("dot") / (F.col("norm") * F.col("own")), 6).alias("wl"))  # one row
    return scored.orderBy(F.desc("wl"), "tree").limit(n)


def screen_index(index: DataFrame, query: Tree, n: int = SCREENED, ratio: float | None = None, key: str = "id") -> DataFrame:
    """(key, wl): the ``n`` trees of similar size of a :func:`type_index` whose histograms are most similar to
    ``query``'s; a scan of sizes, histograms and norms."""
    depths = [r["depth"] for r in rows_of(query)]
    wanted = tree_functions.wl_labels(query.tags, depths, query.children, ROUNDS)
    own = math.sqrt(sum(v * v for v in wanted.values()))
    weights = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    dot = F.aggregate(F.map_entries("histogram"), F.lit(0).cast("long"), lambda s, e: s + e["value"] * F.coalesce(F.element_at(weights, e["key"]), F.lit(0)).cast("long"))
    near = index.filter(size_ratio_ok(len(query), F.col("size"), ratio)).select(key, F.round(dot / (F.col("norm") * F.lit(own)), 6).alias("wl"))
    return near.filter("wl > 0").orderBy(F.desc("wl"), key).limit(n)


def rerank(candidates: DataFrame, trees: DataFrame, query: Tree, key: str = "id", peel_all: bool = False, bound: int = 0) -> DataFrame:
    """(key, ted, match) for each candidate; ted is null where a tree has more than EDIT_NODES nodes.

    ``peel_all`` takes all leading products off the candidates; ``bound`` says how many the query was given, so
    many are taken off both.
    """
    wanted = rows_of(tree_functions.peel(query, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = tree_of(wanted)
        for batch in batches:
            theirs = [tree_functions.peel(tree_of(r), None if peel_all else bound) for r in batch.column(1).to_pylist()]
            small = len(mine) <= EDIT_NODES
            ted = [tree_functions.edit_similarity(mine, t) if small and len(t) <= EDIT_NODES else None for t in theirs]
            match = [tree_functions.structural_match(mine, t) for t in theirs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ted, pa.float64()), pa.array(match, pa.float64())], ["key", "ted", "match"])

    types = dict(trees.dtypes)
    picked = trees.join(candidates.select(key), key, "left_semi").select(key, "nodes")
    return picked.mapInArrow(run, f"key {types[key]}, ted double, match double").withColumnRenamed("key", key)


@dataclass
class Library:
    """What searches read: the :func:`type_index` of the declarations, and the weights of their symbols
    (:func:`theoremill.operators.symbols.weigh`)."""

    types: DataFrame
    weights: DataFrame


def library(declarations: DataFrame) -> Library:
    """Both indexes, written once. ``declarations``: id, type_expr, symbols."""
    return Library(cut(type_index(declarations)), cut(symbols.weigh(symbols.postings(declarations))))


def _constants(query: Tree) -> list[str]:
    return list(dict.fromkeys(p for t, p in zip(query.tags, query.payloads) if t in tree_functions.CONSTANTS))


def _structure(declarations: DataFrame, held: Library, query: Tree, limit: int, ratio: float | None, bound: int = 0) -> DataFrame:
    """(id, score): the best declarations by structure. Without a leading product in the query the candidates
    are all declarations that share one of its symbols, compared without their own products."""
    names = _constants(query)
    wanted = cut(symbols.resolve_query(names, held.weights.select("symbol").distinct()).select("symbol").distinct()) if names else None
    share = symbols.jaccard(held.weights, wanted) if wanted is not None else held.weights.select("id", F.lit(0.0).alias("jaccard")).limit(0)
    bare = query.tags[0] != "Prod"
    if bare:
        picked = cut(share.select("id", F.lit(0.0).alias("wl")))
    else:
        picked = cut(screen_index(held.types, query, SCREENED, ratio))
    fine = rerank(picked, held.types, query, peel_all=bare, bound=bound)
    scored = picked.join(fine, "id").join(share, "id", "left")
    score = clamp(structural_score(F.col("wl"), F.col("ted"), F.col("match"), F.coalesce("jaccard", F.lit(0.0))))
    return scored.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def search_by_structure(declarations: DataFrame, expression: str, limit: int = 50, held: Library | None = None) -> DataFrame:
    """(id, score): declarations whose type is structured like ``expression``, the best first. An expression
    that can't be parsed gives an empty result. ``declarations``: id, type_expr, symbols; ``held``: their
    :func:`library`, if it is written already."""
    query = parse(expression)
    if query is None:
        return declarations.select("id", F.lit(0.0).alias("score")).limit(0)
    return _structure(declarations, held or library(declarations), query, limit, None)


def bound_query(expression: str, known: DataFrame) -> tuple[Tree | None, int]:
    """(tree, n): the expression with its ``n`` free variables bound by products: names that look like
    variables and that no symbol of ``known`` (symbol) is called or ends in."""
    root = tree_functions.parse_nested(expression)
    if root is None:
        return None, 0
    names = tree_functions.free_names(root)
    if not names or root[0] == "Prod":
        return tree_functions.cse(tree_functions.flatten(root)), 0
    asked = known.sparkSession.createDataFrame([(n,) for n in names], "name string")
    meant = {r.name for r in symbols.resolve_names(asked, known).filter("symbol is not null").collect()}  # one row per name of the query
    free = [n for n in names if n not in meant]
    return tree_functions.cse(tree_functions.flatten(tree_functions.bind(root, free))), len(free)


def search_by_type(declarations: DataFrame, expression: str, limit: int = 50, weights: dict[str, float] | None = None, held: Library | None = None) -> DataFrame:
    """(id, score): fusion of the structural, symbol and text rankings for a type expression, whose free
    variables are bound first; the symbol ranking is fused whole, the others are SCREENED long."""
    spark = declarations.sparkSession
    held = held or library(declarations)
    known = held.weights.select("symbol").distinct()
    query, bound = bound_query(expression, known)
    channels = {}
    if query is not None:
        channels["structure"] = _structure(declarations, held, query, SCREENED, 2.0, bound)
        if names := _constants(query):
            picked = symbols.select_weighted(held.weights, symbols.resolve_query(names, known))
            channels["symbols"] = picked.select("id", F.col("relevance").alias("score"))
    words = spark.createDataFrame([(expression,)], "t string").select(type_terms("t")).first()[0] or question_terms(expression)
    channels["text"] = search.bm25(declarations, "id", search.DECLARATION_FIELDS, words, False, SCREENED)
    ranked = None
    for name, hits in channels.items():
        one = symbols.rank(hits.select("id", "score")).select("id", "rank", F.lit(name).alias("channel"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return fusion.fuse(cut(ranked), weights=weights, limit=limit)
