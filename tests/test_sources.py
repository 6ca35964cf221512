import datetime as dt

import pytest

from theoremill.sources import index, pages, records
from theoremill.streaming import ingest, sessions


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.b", "a", "lemma", "s", "t", 3, "[]", 1)], index.TABLES["declarations"])
    index.write({"declarations": rows}, str(tmp_path / "i"), {"made": "now"})
    found = index.Index(spark, str(tmp_path / "i"))
    assert found.meta("made") == "now" and found.by_name("a.b").count() == found.by_ids([1]).count() == 1
    assert found.by_ids([]).count() == found.optional("aliases").count() == found.by_module("a", 1).count() == 0
    with pytest.raises(index.IntegrityError):
        index.check({"declarations": rows.union(rows)})
    with pytest.raises(index.IntegrityError):
        index.check({"dependencies": spark.createDataFrame([(1, 1, "uses")], index.TABLES["dependencies"])})
    with pytest.raises(index.IndexMissing):
        index.Index(spark, str(tmp_path / "none"))
    with pytest.raises(index.IndexVersionMismatch):
        index.write({"declarations": rows}, str(tmp_path / "j"), {"schema_version": "0"})
        index.Index(spark, str(tmp_path / "j"))


def test_records(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"t":"s","f":"a.v","s":"P","c":"auto."}\n{"t":"g","s":"Q"}\n{"t":"s","f":"a.v","s":"P","c":""}\nbroken\n')
    assert [tuple(r) for r in records.read_compact(spark, str(tmp_path / "c.jsonl")).collect()] == [("a.v", "P", "auto.")]
    assert records.bad_lines(spark, str(tmp_path / "c.jsonl")).count() == 1
    (tmp_path / "t.jsonl").write_text('{"record_type":"proof_trace","theorem_name":"x","source_file":"a.v","project_id":"p","steps":[{"step_index":0,"goals":[{"type":"P","hypotheses":[{"name":"h","type":"T"}]}]},{"step_index":1,"tactic":"auto.","duration_ms":20,"goals":[{"type":"Q","hypotheses":[]}]}]}\n')
    traces = records.read_traces(spark, str(tmp_path / "t.jsonl"))
    assert [tuple(r)[2:] for r in records.flat_steps(traces).collect()] == [(1, "h : T\nP", "auto.", 0.02)]
    assert sorted(map(tuple, records.compact(traces).collect()), key=str) == [("g", None, "Q", None), ("s", "a.v", "h : T\nP", "auto.")]


def test_dot(spark, tmp_path):
    (tmp_path / "g.dot").write_text('digraph g {\n"a.x" -> "b.y";\n"a.x" -> "b.y"\n"lone" [label="z"];\n}\n')
    edges, nodes = records.read_dot(spark, str(tmp_path / "g.dot"))
    assert [tuple(r) for r in edges.collect()] == [("a.x", "b.y")] and {r.node for r in nodes.collect()} == {"a.x", "b.y", "lone"}
    (tmp_path / "bad.dot").write_text('digraph g { "a" -> "b"')
    with pytest.raises(records.DotError):
        records.read_dot(spark, str(tmp_path / "bad.dot"))


def test_logs(spark):
    lines = spark.createDataFrame([("Chars 0 - 26 [Require~Import] 0.12 secs (0.1u,0.02s)",), ("other",), ("─induction ---- 1.5%  90.0%  3  0.250s",), ("ax : forall x, P : Q",)], "value string")
    assert [tuple(r) for r in records.timing_lines(lines).collect()] == [(0, 26, "[Require~Import]", 0.12, 0.1, 0.02)]
    assert [tuple(r) for r in records.profile_lines(lines).collect()] == [("induction", 1.5, 90.0, 3, 0.25)]
    assert [tuple(r) for r in records.assumptions(lines).collect()] == [("ax", "forall x, P : Q")]


def test_pages(spark):
    long = "word " * 120
    html = f"""<html><nav>menu</nav><div id="main"><div class="doc"><a id="lab1"></a><h1 class="section">One</h1><p>{long}</p></div>
    <div class="code">Lemma x.  \n</div><div class="doc"><h2 class="section">Small</h2>few<br>words</div>
    <div class="doc"><h2 class="section">Next</h2>{long}</div><div class="doc"><h3 class="section">Exercise: e</h3>do</div></div>"""
    rows = spark.createDataFrame([("p", html, "Chap"), ("q", None, "C"), ("r", "", None)], "page string, html string, chapter string")
    found = pages.chunk_pages(rows).orderBy("page", "place").collect()
    assert [(r.section_title, r.section_path, r.code_blocks) for r in found] == [("One", ["Chap", "One"], ["Lemma x."]), ("Small", ["Chap", "One", "Small"], []), ("Exercise: e", ["Chap", "One", "Next", "Exercise: e"], [])]
    assert found[0].anchor_id == "lab1" and found[1].token_count == 121


def test_ingest(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    before = spark.createDataFrame([("a", "1"), ("b", "0"), ("d", "4")], "path string, hash string")
    assert {tuple(r) for r in ingest.classify(now, before).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "removed")}
    assert {r.path for r in ingest.work_left(now, before).collect()} == {"b", "c"} and ingest.work_left(now, None).count() == 3


def test_streamed_sessions(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, at(0)), (1, at(20)), (1, at(70)), (2, at(5)), (1, None), (9, at(900))]
    table = spark.createDataFrame(rows, "user long, ts timestamp")
    expected = {(1, at(0), 2), (1, at(70), 1), (2, at(5), 1), (9, at(900), 1)}
    assert {(r.user, r.begins, r.events) for r in sessions.sessions(table, "user", "ts").collect()} == expected
    table.write.parquet(str(tmp_path / "in"))
    stream = sessions.sessions(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "user", "ts")
    query = stream.writeStream.format("memory").queryName("s").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    found = {(r.user, r.begins, r.events) for r in spark.table("s").collect()}
    assert found == expected - {(9, at(900), 1)}  # still open at the watermark


def test_deduplicated_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 1))], "id long, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest.deduplicated_append(stream, ["id"], str(tmp_path / "out"), str(tmp_path / "cp"), "ts").awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
