"""Operators whose worked examples SQL oracles don't cover."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from theoremill.operators import audits, dataset, fusion, graph, symbols, timing, traces, trees
from theoremill.runtime import latest, lookup, row_index, salted_join
import theoremill.runtime as runtime


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_symbol_selection(spark):
    index = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B"), (2, "C"), (3, "X"), (4, "A"), (4, "C")], "id long, symbol string")
    freq, start = symbols.frequencies(index), spark.createDataFrame([("A",)], "symbol string")
    one = {r.id for r in symbols.select_relevant(index, freq, start, p=0.0, rounds=1).collect()}
    five = {r.id for r in symbols.select_relevant(index, freq, start, p=0.0, rounds=5).collect()}
    assert one == {1, 4} and five == {1, 2, 4}
    assert symbols.select_relevant(index, freq, start.limit(0)).count() == 0


def test_fusion(spark):
    rank = lambda **c: spark.createDataFrame([(k, d, i + 1) for k, ds in c.items() for i, d in enumerate(ds)], "channel string, id string, rank int")
    assert [r.id for r in fusion.fuse(rank(a=["d1", "d2", "d3"], b=["d2", "d3", "d4"])).collect()] == ["d2", "d3", "d1", "d4"]
    found = fusion.fuse(rank(a=["d1", "d2"], b=["d2", "d3"], c=["d3", "d1"]), weights={"a": 1.0, "b": 2.0, "c": 0.5}).collect()
    assert [(r.id, r.score) for r in found] == [("d2", 0.048916), ("d3", 0.040455), ("d1", 0.024458)]


def test_closure(spark):
    e = edges(spark, ("A", "B"), ("B", "C"), ("C", "D"))
    assert sorted(map(tuple, graph.closure(e, nodes(spark, "A")).collect())) == [("A", 0), ("B", 1), ("C", 2), ("D", 3)]
    assert {r.node for r in graph.closure(e, nodes(spark, "A"), 2).collect()} == {"A", "B", "C"}
    assert {r.node for r in graph.impact(e, nodes(spark, "C")).collect()} == {"A", "B", "C"}
    with pytest.raises(graph.ResultTooLarge):
        graph.closure(e, nodes(spark, "A"), most=2)
    assert {tuple(r) for r in graph.induced(e, nodes(spark, "A", "B", "D")).collect()} == {("A", "B")}


def test_components(spark):
    e = edges(spark, ("B", "C"), ("C", "A"), ("A", "B"), ("D", "E"), ("X", "X"), ("P", "Q"), ("Q", "P"), ("A", "P"))
    assert {tuple(r) for r in graph.components(e).collect()} == {("A", "A"), ("B", "A"), ("C", "A"), ("P", "P"), ("Q", "P")}
    assert graph.components(edges(spark, ("A", "B"))).count() == 0


def test_module_summary(spark):
    n = graph.with_module(nodes(spark, "Foo.A", "Foo.B", "Bar.C"))
    found = {r.module: (r.fan_in, r.fan_out, r.nodes) for r in graph.module_summary(edges(spark, ("Foo.A", "Foo.B"), ("Foo.A", "Bar.C")), n).collect()}
    assert found == {"Foo": (0, 1, 2), "Bar": (1, 0, 1)}


def test_strict_cycles(spark):
    c = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string, kind string")
    assert [tuple(r) for r in graph.strict_cycles(c(("u", "v", "lt"), ("v", "w", "le"), ("w", "u", "eq"))).collect()] == [("u", "v", 3)]
    assert graph.compatible(c(("u", "v", "lt")), c(("v", "w", "le"))) and not graph.compatible(c(("u", "v", "lt")), c(("v", "u", "le")))


def test_band_match(spark):
    a = spark.createDataFrame([("f", 1, 100), ("f", 2, 150), ("f", 3, 9000)], "file string, id long, offset long")
    b = spark.createDataFrame([("f", 7, 120), ("f", 8, 600), ("f", 9, 20000)], "file string, id long, offset long")
    assert sorted(tuple(r)[1:] for r in timing.band_match(a, b, "file", "offset").collect()) == [(1, 7), (2, 8)]


def test_versions(spark):
    order = ["8.18~beta", "8.18", "8.18+flambda", "8.18.0", "8.18.2", "8.18.10", "8.19", "10"]
    keys = [r[0] for r in spark.createDataFrame([(v,) for v in order], "v string").select(audits.version_key("v")).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_axioms(spark):
    rows = spark.createDataFrame([("classic", "x"), ("Lib.Reals.a", "x"), ("b", "forall P : Prop, P \\/ ~ P"), ("c", "nat")], "n string, t string")
    found = rows.select(audits.axiom_category(F.col("n"), F.col("t"), {"classic": "classical"}, {"Lib.Reals": "reals"})).collect()
    assert [r[0] for r in found] == ["classical", "reals", "classical", "custom"]


def test_duplicate_names(spark):
    rows = spark.createDataFrame([(0, 1, "a"), (1, 5, "a"), (1, 6, "b")], "library int, id long, name string")
    assert sorted(map(tuple, audits.merge_declarations(rows).collect())) == [(0, 1, 1, "a"), (1, 6, 2, "b")]
    with pytest.raises(audits.DuplicateNames):
        audits.merge_declarations(rows, "raise")


def test_distributed_index_and_joins(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{i:04}",) for i in range(500)], "k string").repartition(7)
    assert [(r.k, r["index"]) for r in row_index(rows, ["k"]).orderBy("k").collect()] == [(f"k{i:04}", i) for i in range(500)]
    monkeypatch.setattr(runtime, "TASK_ROWS", 10)
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(300)] + [(None, 5)], "k int, x int")
    right = spark.createDataFrame([(i, -i) for i in range(200)], "k int, y int")
    expected = {(k, x, -k) for k, x in ((1 if i % 2 else i, i) for i in range(300)) if k < 200}
    assert {tuple(r) for r in lookup(left, right, "k").collect()} == expected
    assert {(r.k, r.x, r.y) for r in salted_join(left, right, "k").collect()} == expected
    assert lookup(left, right, "k", "left").count() == 301


def test_latest(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, day(1), "a"), (1, day(2), "b"), (1, day(2), "c"), (1, None, "z"), (2, None, None), (None, day(1), "n")]
    table = spark.createDataFrame(rows, "id long, at timestamp, v string")
    assert sorted(((r.id, r.v) for r in latest(table, "id", ["at"]).collect()), key=str) == [(1, "c"), (2, None)]
    assert latest(table.limit(0), "id", ["at"]).count() == 0


def test_sampling(spark):
    rows = spark.createDataFrame([(i, "a" if i < 50 else "b") for i in range(53)], "id long, family string")
    assert {r.family: r["count"] for r in dataset.undersample(rows, "family", "id", 10, 5).groupBy("family").count().collect()} == {"a": 10}
    assert {r.family: r["count"] for r in dataset.oversample(rows, "family", "id", 10).groupBy("family").count().collect()} == {"a": 50, "b": 10}


def test_wl_histogram(spark):
    parsed = trees.parse_types(spark.createDataFrame([(1, "A -> B"), (2, None), (3, "((")], "id long, type_expr string"))
    found = trees.wl_histograms(trees.node_table(parsed), 1).collect()
    assert sum(r.n for r in found) == 6 and all(len(r.label) == 32 for r in found) and {r.tree for r in found} == {1}


def test_structure_search_finds_itself(spark):
    rows = spark.createDataFrame([(1, "x", "", "M", "forall n, P n -> Q n", ["P"]), (2, "y", "", "M", "A -> B", []), (3, "z", "", "M", None, [])], "id long, name string, statement string, module string, type_expr string, symbols array<string>")
    assert trees.search_by_structure(rows, "forall n, P n -> Q n").first().id == 1
    assert trees.search_by_type(rows, "forall n, P n -> Q n").first().id == 1
    assert trees.search_by_structure(rows, "((").count() == 0


def test_salted_join_of_keys_hot_on_either_side(spark, monkeypatch):
    from theoremill import runtime

    monkeypatch.setattr(runtime, "TASK_ROWS", 10)
    left = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 0), (3, 0), (3, 0)] + [(None, 1)], "k int, a int")
    right = spark.createDataFrame([(1, i) for i in range(5)] + [(2, i) for i in range(60)] + [(3, 9), (4, 9)], "k int, b int")
    got = sorted(tuple(r) for r in runtime.salted_join(left, right, "k", 4).collect())
    assert got == sorted(tuple(r) for r in left.join(right, "k").collect()) and len(got) == 200 + 60 + 2


def test_duplicate_proofs(spark):
    rows = [("p", "a", 1, "G", "intros  n."), ("p", "a", 2, "H", "auto."), ("p", "b", 5, "G", " intros n."), ("q", "b", 7, "x", "auto.\n"), ("p", "b", 9, "y", "auto."), ("p", "c", 1, "G", "auto."), ("p", "c", 2, "G", "intros n."), ("p", "d", 1, None, None), ("p", "e", 4, "", "")]
    found = traces.duplicates(spark.createDataFrame(rows, "project string, theorem string, step int, state string, tactic string")).collect()
    assert sorted(tuple(r) for r in found) == [("p", "a", "p/a", 2), ("p", "b", "p/a", 2), ("p", "c", "p/c", 1), ("p", "d", "p/d", 2), ("p", "e", "p/d", 2), ("q", "b", "q/b", 1)]


def test_histograms_of_large_trees_are_the_same(spark, monkeypatch):
    parsed = trees.parse_types(spark.createDataFrame([(1, "forall n, P n -> Q n /\\ R n"), (2, "A -> B"), (3, "A")], "id long, type_expr string"))
    nodes = trees.node_table(parsed)
    every = lambda: sorted(tuple(r) for r in trees.wl_histograms(nodes).collect())
    by_tree = every()
    monkeypatch.setattr(trees, "TASK_NODES", 3)
    assert every() == by_tree
    index = {r.id: r for r in trees.type_index(spark.createDataFrame([(1, "forall n, P n -> Q n /\\ R n"), (2, "A -> B"), (3, "A"), (4, None)], "id long, type_expr string")).collect()}
    assert by_tree == sorted((i, k, n) for i, r in index.items() for k, n in r.histogram.items()) and [index[i].size for i in (2, 3)] == [3, 1]
