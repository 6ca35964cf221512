import datetime as dt
import random

import pytest

from theoremill.llm.overlap import cosine_join, overlap_report, split_overlaps, term_classes

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "pair_id long, split string, state_text string, recorded_at timestamp, project_id string, theorem_name string, key string, terms int"


def states(seed, n=160):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.randint(10, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"w{r.randint(0, 400)}"
        text = r.choice([" ", "\n", "\t "]).join(w.upper() if r.random() < 0.1 else w for w in words)
        rows.append((i, r.choice(["train", "train", "val", "test"]), text, DAY, f"p{i % 3}", f"t{i}", "k", 1))
    return rows


def brute(rows, jaccard=0.8, least=15):
    sets = {r[0]: (r[1], set(r[2].lower().split())) for r in rows}
    return {(a, b) for a, (s, x) in sets.items() for b, (t, y) in sets.items() if s == "train" and t != "train" and min(len(x), len(y)) >= least and len(x & y) >= jaccard * len(x | y)}


def test_against_all_pairs(spark):
    rows = states(1)
    extra = [(900, "train", None, DAY, None, None, None, None), (901, "val", "", DAY, None, None, None, None), (None, "train", rows[0][2], DAY, None, None, None, None), (902, None, rows[0][2], DAY, None, None, None, None)]
    repeated = [(0, "test", "older text", DAY - dt.timedelta(1), None, None, None, None)]
    found = split_overlaps(spark.createDataFrame(rows + extra + repeated, SCHEMA)).collect()
    expected = brute(rows)
    assert {tuple(r) for r in found} == expected and len(found) == len(expected) > 20


@pytest.mark.parametrize("weights", ["binary", "idf"])
def test_cosine_join_loses_nothing(spark, weights):
    rows = spark.createDataFrame(states(2), SCHEMA).selectExpr("pair_id", "state_text", "if(split = 'train', 'left', 'right') as side")
    classes, _ = term_classes(rows, "pair_id", "state_text", "side", 3)
    near = {(r.left, r.right): r.dot for r in cosine_join(classes, 0.7, weights).collect()}
    every = {(r.left, r.right): r.dot for r in cosine_join(classes, 1e-9, weights).collect()}
    assert near.keys() == {k for k, d in every.items() if d >= 0.7} and len(near) > 20


def test_report(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "train", text, DAY, "p", "a", "k", 1), (2, "val", text, DAY, "q", "b", "k", 1), (3, "test", text + " x", DAY, "q", "c", "k", 1), (4, "train", text, DAY, "p", None, "k", 1)]
    clusters = spark.createDataFrame([(1, ["a", "b", None, "b"]), (2, ["a", "b"]), (3, None)], "cluster_id long, members array<string>")
    found = overlap_report(spark.createDataFrame(rows, SCHEMA), clusters).collect()
    assert sorted(map(tuple, found)) == [("test", "q", 2, 1, 0), ("val", "q", 2, 1, 1)]


def test_empty(spark):
    assert split_overlaps(spark.createDataFrame([], SCHEMA)).count() == 0


def test_frequencies_are_exact_either_way(spark, monkeypatch):
    import theoremill.llm.overlap as module

    rows = spark.createDataFrame(states(3), SCHEMA).selectExpr("pair_id", "state_text", "if(split = 'train', 'left', 'right') as side")
    classes, _ = term_classes(rows, "pair_id", "state_text", "side", 3)
    every = lambda: sorted((r.cls, list(zip(r.terms, r.dfs)), r.is_left, r.is_right) for r in module.document_frequencies(classes).collect())
    broadcast = every()
    monkeypatch.setattr(module, "TABLE_TERMS", 10)
    assert every() == broadcast
    held = {r.cls: set(r.terms) for r in classes.collect()}
    assert all(d == sum(t in h for h in held.values()) for _, pairs, _, _ in broadcast[:5] for t, d in pairs)
