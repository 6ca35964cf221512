"""Queries that take whole tables or lists, against brute force."""

from collections import defaultdict

import pyarrow.parquet as pq

from theoremill.operators import graph, trees
from theoremill.plans import retrieval
from theoremill.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"
SEARCHED = "id long, name string, statement string, module string, type_expr string, symbols array<string>"


def test_cycles_of_the_dependency_graph(spark):
    rows = pq.read_table(f"{FOLDER}/dependencies.parquet", columns=["src", "dst", "relation"]).to_pylist()
    ahead = defaultdict(set)
    for r in rows:
        if (r["relation"] or "").strip(" \t\r\n").lower() == "uses" and None not in (r["src"], r["dst"]) and r["src"] != r["dst"]:
            ahead[r["src"]].add(r["dst"])

    def reached(node):
        seen, todo = set(), [node]
        while todo:
            for n in ahead.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    reach = {n: reached(n) for n in list(ahead)}
    expected = {(n, min(m for m in reach[n] if n in reach.get(m, ()))) for n in reach if n in reach[n]}
    assert expected and {tuple(r) for r in QUERIES["detect_cycles_uses"](spark, FOLDER).collect()} == expected


def test_structure_search_weighs_every_candidates_symbols(spark, monkeypatch):
    # Declaration 9 has the wanted structure and shares a symbol; those in front fill a list by Jaccard alone.
    monkeypatch.setattr(trees, "SCREENED", 3)
    rows = [(i, f"a{i}", "", "M", None, ["P", "Q"]) for i in range(1, 6)] + [(9, "x", "", "M", "forall n, P n -> Q n", ["P", "Q", "R"])]
    table = spark.createDataFrame(rows, SEARCHED)
    assert [tuple(r) for r in trees.search_by_structure(table, "forall n, P n -> Q n").collect()] == [(9, 0.95)]


def test_type_search_fuses_the_whole_symbol_ranking(spark, monkeypatch):
    monkeypatch.setattr(trees, "SCREENED", 2)
    rows = [(i, f"a{i}", "", "M", None, ["P", "Q"]) for i in range(1, 7)]
    table = spark.createDataFrame(rows, SEARCHED)
    assert {r.id for r in trees.search_by_type(table, "forall n, P n -> Q n").collect()} == set(range(1, 7))


def test_fusion_of_whole_lists(spark, monkeypatch):
    lists = retrieval._channels(spark, FOLDER).collect()
    newest = {r["id"] for r in pq.read_table(f"{FOLDER}/declarations.parquet", columns=["id"]).to_pylist()} - {None}
    assert {r.id for r in lists if r.channel == "symbols"} == newest and len(newest) > 100
    for name, weights in (("rrf_fuse_whole", {}), ("weighted_rrf_whole", {"size": 2.0, "symbols": 0.5, "name": 0.0})):
        scores, first = defaultdict(float), {}
        for r in lists:
            if w := weights.get(r.channel, 1.0):
                scores[r.id] += w / (60 + r["rank"])
                first[r.id] = min(r["rank"], first.get(r.id, r["rank"]))
        expected = sorted(((-round(s, 6), first[i], i) for i, s in scores.items()))[:50]
        assert [(r.id, round(r.score, 6)) for r in QUERIES[name](spark, FOLDER).collect()] == [(i, -s) for s, _, i in expected]
    monkeypatch.setattr(retrieval.fusion, "sweep", lambda ranked, truth, grid: ranked)
    assert QUERIES["fusion_sweep"](spark, FOLDER).count() == len(lists)


def test_long_strict_cycle(spark, monkeypatch):
    # Finding the component of a ring takes as many rounds again, so it is given.
    n = 34
    ring = spark.createDataFrame([(i, (i + 1) % n, "le" if i else "lt") for i in range(n)], "src int, dst int, kind string")
    monkeypatch.setattr(graph, "components", lambda edges: spark.range(n).selectExpr("cast(id as int) AS node", "0 AS component"))
    assert not graph.compatible(ring, ring.limit(0))
    assert [tuple(r) for r in graph.strict_cycles(ring).collect()] == [(0, 1, n)]
