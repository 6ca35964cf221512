import pytest
from pyspark.sql import functions as F

from theoremill.functions.versions import Interval, parse_constraint, satisfies
from theoremill.operators import tactics


def test_comparison(spark):
    rows = spark.createDataFrame([("auto", ["a", "b"]), ("lia", ["b", "c"])], "tactic string, capabilities array<string>")
    assert [r[0] for r in tactics.shared_capabilities(rows).collect()] == ["b"]
    assert [tuple(r) for r in tactics.pairwise_differences(rows).collect()] == [("auto", "lia", ["a"], ["c"])]


def test_hints_and_instances(spark):
    hints = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "hint string")
    attempts = spark.createDataFrame([("h1", False), ("h1", True), ("h2", False)], "hint string, success boolean")
    assert {tuple(r) for r in tactics.classify_hints(hints, attempts).collect()} == {("h1", "matched"), ("h2", "attempted_but_rejected"), ("h3", "not_considered")}
    trace = spark.createDataFrame([("g", 2, "i2", True), ("g", 1, "i1", True), ("g", 0, "i0", False), ("k", 1, "j", True)], "goal string, place int, instance string, success boolean")
    assert [tuple(r) for r in tactics.instance_conflicts(trace).collect()] == [("g", "i1", 2)]


def test_unfinished(spark):
    text = "Lemma a. (* admit. *)\nadmit.\nAdmitted. (* x *)\nexact admitted."
    assert [tuple(r) for r in tactics.unfinished(spark.createDataFrame([("f", text), ("g", None)], "file string, text string")).collect()] == [("f", 2, "admit"), ("f", 3, "Admitted")]


def test_constraints(spark):
    assert parse_constraint("") == [Interval()] and parse_constraint('>= "8.14" & < "8.20~"') == [Interval("8.14", True, "8.20~", False)]
    for bad in (">= ", "8.1", "(>= 1", ">= 1 )", "& < 2"):
        with pytest.raises(ValueError):
            parse_constraint(bad)
    versions = spark.createDataFrame([(v,) for v in ("8.13", "8.14", "8.19.1", "8.20~rc", "8.20", "9.0")], "v string")
    allowed = lambda text: [r[0] for r in versions.filter(satisfies(F.col("v"), parse_constraint(text))).collect()]
    assert allowed('>= "8.14" & < "8.20~"') == ["8.14", "8.19.1"]
    assert allowed("(< 8.14 | > 8.20) & != 9.0") == ["8.13"]
    assert allowed("= 8.20 | = 9.0") == ["8.20", "9.0"]
