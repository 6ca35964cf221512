"""Worked examples of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from theoremill.functions import names, scores, texts


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], schema).select(column).collect()]


def test_query_terms():
    assert texts.name_query("Stdlib.Arith.PeanoNat") == (["Stdlib", "Arith", "PeanoNat"], True)
    assert texts.name_query("nat_add_comm") == (["nat", "add", "comm"], True)
    assert texts.name_query("addition commutative") == (["addition", "commutative"], False)
    assert texts.name_query("  ") == ([], False) and len(texts.name_query("a." * 50)[0]) == 20
    assert texts.question_terms("How do I use induction?") == ["induction"]
    assert texts.question_terms("What is a monoid?") == ["monoid"] and texts.question_terms("What is it") == ["what", "is", "it"]


def test_families(spark):
    rows = ["intro x.", "by apply H", "by ", "", "move=> x", "case/andP", "Rewrite H; auto", ";x", "now auto", "1:lia", "(destruct(q)"]
    assert values(spark, texts.tactic_family("x"), rows) == ["intros", "apply", "by", "other", "move", "case", "rewrite", "other", "auto", "1:lia", "(destruct(q)"]
    assert values(spark, texts.normalized_family("x"), ["1:lia", "(destruct(q)", "eapply?-", "("]) == ["lia", "destruct", "eapply", "other"]
    assert values(spark, texts.tactic_keywords("x"), ["Intros x; auto.", "; ", None]) == [["intros", "auto"], [], None]


def test_goals(spark):
    rows = ["forall x, P", "(a + b) = c", "n <= m", "exists x", "a b c", "", "f /\\ g -> h", "x * y"]
    assert values(spark, texts.goal_head("x"), rows) == ["forall", "eq", "le", "ex", "other", "other", "and", "mult"]
    assert values(spark, texts.goal_type("x"), ["h : nat\nP h\n\nQ", "P"]) == ["P h", "P"]
    state = "n : nat\nk : T := a b c\nn = n\n\nTrue"
    column = texts.structured_state("x", F.lit(None).cast("string"), F.lit(12), F.lit(2), 2)
    assert values(spark, column, [state, ""]) == ["[PREV=none] [DEPTH=10+] [NGOALS=2] [HEAD=eq] [HYP] n [TYPE] nat [HYP] k [TYPE] T [BODY] a b [GOAL] n = n [GOALSEP] [GOAL] True", "[PREV=none] [DEPTH=10+] [NGOALS=2] [HEAD=other]"]


def test_names(spark):
    assert values(spark, names.suffixes("x"), ["a.b.c", "a"]) == [["b.c", "c"], []]
    assert values(spark, names.module_of("x"), ["a.b.c", "a"]) == ["a.b", ""]
    assert values(spark, names.alias_prefix(F.col("x")), ["Coq.Init", "Stdlib.Init", "Other"]) == ["Stdlib.Init", "Coq.Init", None]
    assert values(spark, names.alias_symbol(F.col("x")), ["Coq.Init.x", "Corelib.y", "z"]) == ["Stdlib.Init.x", "Stdlib.y", "z"]
    assert values(spark, names.kind_of_form(F.col("x")), ["Lemma", "Ltac", "Record", "Fancy"]) == ["lemma", None, "inductive", "definition"]
    assert values(spark, names.local_name(F.col("x"), F.lit("theories/Arith/Nat.v")), ["Lib.Arith.Nat.Sub.add", "other.x"]) == ["Sub.add", "x"]
    assert values(spark, names.constants("x"), ["@a.b c @d @a.b"]) == [["a.b", "d"]]
    assert values(spark, texts.type_terms("x"), ["forall n, List.map n (x : T.y2) List"]) == [["List", "map", "y2"]]
    assert values(spark, texts.label("x", 10), ['a "b" [c]', "x" * 20]) == ["a 'b' c ", "xxxxxxx..."]
    assert values(spark, texts.nfc("x"), ["é", None]) == ["é", None]


def test_scores(spark):
    assert values(spark, scores.symbol_weight(F.col("x")), [1, None], "x long") == [3.0, 3.0]
    pairs = [(30, 35), (30, 40), (599, 718), (599, 719), (600, 1080), (600, 1081), (10, 12)]
    assert [values(spark, scores.size_ratio_ok(q, F.col("x")), [c], "x int")[0] for q, c in pairs] == [True, False, True, False, True, False, True]
    score = lambda ted: spark.range(1).select(scores.structural_score(F.lit(0.8), F.lit(ted).cast("double"), F.lit(0.7), F.lit(0.6))).first()[0]
    assert math.isclose(score(0.9), 0.78) and math.isclose(score(None), 0.7)
    assert spark.range(1).select(scores.jaccard(F.array(), F.array())).first()[0] == 0
    assert values(spark, scores.difficulty(F.col("x")), [5, 20, 21], "x int") == ["short", "medium", "long"]
    assert values(spark, scores.domain(F.col("x")), ["Lib.ZArith", "My.Ring", "Prop", "z"]) == ["arithmetic", "algebra", "logic", "other"]


def test_bottlenecks(spark):
    rows = [("ProofClose", "Qed.", 9.0), ("Tactic", "simpl", 3.0), ("Tactic", "eauto 7", 1.5), ("Tactic", "repeat x", 3.5), ("Tactic", "x", 31.0), ("Tactic", "x", 1.0)]
    table = spark.createDataFrame(rows, "kind string, snippet string, s double")
    category = scores.bottleneck(F.col("kind"), F.col("snippet"), F.col("s"), F.lit(10.0))
    found = table.select(category.alias("c"), scores.severity(category, F.col("s"), F.lit(100.0))).collect()
    assert [tuple(r) for r in found] == [("SlowQed", "warning"), ("SlowReduction", "warning"), ("HighSearchDepth", "warning"), ("ExpensiveMatch", "warning"), ("General", "critical"), (None, None)]
