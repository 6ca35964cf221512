"""Line formats: proof traces and training rows (JSON Lines), dependency graphs (DOT), timing logs, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GOALS = "array<struct<type:string,hypotheses:array<struct<name:string,type:string,body:string>>>>"
STEPS = f"array<struct<step_index:int,tactic:string,duration_ms:double,goals:{_GOALS},premises:array<struct<name:string,kind:string>>>>"
#: Traces, partial traces and errors share one table; record_type tells them apart.
TRACES = f"record_type string, schema_version int, theorem_name string, source_file string, project_id string, module_path string, total_steps int, completed_steps int, failure_at_step int, failure_kind string, failure_message string, error_kind string, error_message string, steps {STEPS}"
# Kinds of extraction errors.
ERROR_KINDS = ("timeout", "backend_crash", "tactic_failure", "load_failure", "no_proof_body", "unknown")


def read_traces(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Trace records; a malformed line raises, or is left out where not ``strict``."""
    return spark.read.schema(TRACES).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines that are no JSON objects, for error reports."""
    return spark.read.text(path).filter("trim(value) <> ''").filter(F.from_json("value", "record_type string, _corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"].isNotNull())


def read_compact(spark: SparkSession, path: str) -> DataFrame:
    """(file, state, tactic) of the step rows; lines are parsed only if their first characters name a step."""
    lines = spark.read.text(path).filter(F.left("value", F.lit(25)).rlike(r'"t": ?"s"'))
    rows = lines.select(F.from_json("value", "t string, f string, s string, c string").alias("r")).select("r.*")
    return rows.filter("t = 's' and c <> ''").select(F.col("f").alias("file"), F.col("s").alias("state"), F.col("c").alias("tactic"))


def goals_text(goals: Column) -> Column:
    """Goals as text: hypotheses one to a line, then the goal; goals are parted by an empty line."""
    lines = lambda g: F.array_append(F.transform(F.coalesce(g.hypotheses, F.array()), lambda h: F.concat(h["name"], F.lit(" : "), h["type"])), g["type"])
    return F.array_join(F.transform(goals, lambda g: F.array_join(lines(g), "\n")), "\n\n")


def compact(traces: DataFrame) -> DataFrame:
    """Training rows of traces: (t, f, s, c), a step row for each tactic with the state in front of it, and a
    goal row for each further distinct state of the proof."""
    steps = traces.filter(F.col("steps").isNotNull()).select("project_id", "theorem_name", F.col("source_file").alias("f"), F.monotonically_increasing_id().alias("trace"), "steps")
    states = F.transform("steps", lambda s: F.struct(s.tactic.alias("tactic"), goals_text(F.coalesce(s.goals, F.array().cast(_GOALS))).alias("s")))
    rows = steps.select("trace", "f", states.alias("x"))
    pairs = F.filter(F.transform(F.sequence(F.lit(2), F.size("x")), lambda k: F.struct(F.element_at("x", k - 1).s.alias("s"), F.element_at("x", k).tactic.alias("c"))), lambda p: (p.s != "") & (p.c != ""))
    pairs = F.when(F.size("x") > 1, pairs).otherwise(F.array().cast("array<struct<s:string,c:string>>"))
    rows = rows.withColumn("pairs", pairs)
    left = F.array_except(F.filter(F.transform("x", lambda s: s.s), lambda s: s != ""), F.transform("pairs", lambda p: p.s))
    step = rows.select("f", F.inline("pairs")).select(F.lit("s").alias("t"), "f", "s", "c")
    goal = rows.select(F.explode(left).alias("s")).select(F.lit("g").alias("t"), F.lit(None).cast("string").alias("f"), "s", F.lit(None).cast("string").alias("c"))
    return step.unionByName(goal)


def flat_steps(traces: DataFrame) -> DataFrame:
    """(project, theorem, step, state, tactic, seconds): traces as rows of steps, the state in front of each."""
    at = F.posexplode("steps").alias("step", "x")
    rows = traces.select(F.col("project_id").alias("project"), F.col("theorem_name").alias("theorem"), "steps", at).filter("step > 0")
    before = goals_text(F.coalesce(F.element_at("steps", F.col("step")).goals, F.array().cast(_GOALS)))
    return rows.select("project", "theorem", "step", before.alias("state"), F.col("x.tactic").alias("tactic"), (F.col("x.duration_ms") / 1000).alias("seconds"))


def write_json(rows: DataFrame, path: str, bucket: str | None = None) -> None:
    """JSON Lines, in one folder for each ``bucket`` if a column is named."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(bucket) if bucket else writer).json(path)


def write_nested_as_text(traces: DataFrame, path: str) -> None:
    """Parquet with the nested steps as JSON text, for tools that read flat tables only."""
    traces.withColumn("steps", F.to_json("steps")).write.mode("overwrite").parquet(path)


class DotError(ValueError):
    """The file is no finished DOT graph."""


def read_dot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of DOT graphs: distinct (src, dst) and (node). A file without its closing brace raises."""
    files = spark.read.text(path, wholetext=True)
    if not files.filter(~F.rtrim(F.regexp_replace("value", r"\s+$", "")).endswith("}")).isEmpty():
        raise DotError(path)
    lines = spark.read.text(path)
    name = r'"([^"]+)"'
    edges = lines.filter(F.col("value").rlike(rf"{name}\s*->\s*{name}")).select(F.regexp_extract("value", rf"{name}\s*->\s*{name}", 1).alias("src"), F.regexp_extract("value", rf"{name}\s*->\s*{name}", 2).alias("dst")).distinct()
    plain = lines.filter(~F.col("value").contains("->")).select(F.regexp_extract("value", rf"^\s*{name}", 1).alias("node")).filter("node <> ''")
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).unionByName(plain).distinct()
    return edges, nodes


def timing_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Sentences of timing logs: char_start, char_end, snippet and seconds; other lines are left out."""
    pattern = r"^Chars (\d+) - (\d+) (\S+) ([\d.]+) secs \(([\d.]+)u,([\d.]+)s\)$"
    text = F.btrim(column)
    part = lambda k, kind: F.regexp_extract(text, pattern, k).cast(kind)
    return lines.filter(text.rlike(pattern)).select(
        part(1, "int").alias("char_start"), part(2, "int").alias("char_end"), part(3, "string").alias("snippet"), part(4, "double").alias("real_s"), part(5, "double").alias("user_s"), part(6, "double").alias("sys_s")
    )


def profile_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a tactic profile: tactic, shares of own and all time, calls and longest time."""
    pattern = "^\\s*─(\\w+)\\s+[-─]*\\s+([\\d.]+)%\\s+([\\d.]+)%\\s+(\\d+)\\s+([\\d.]+)s\\s*$"
    part = lambda k, kind: F.regexp_extract(column, pattern, k).cast(kind)
    return lines.filter(F.col(column).rlike(pattern)).select(
        part(1, "string").alias("tactic"), part(2, "double").alias("own_share"), part(3, "double").alias("total_share"), part(4, "int").alias("calls"), part(5, "double").alias("longest_s")
    )


def assumptions(lines: DataFrame, column: str = "value") -> DataFrame:
    """(axiom, type) of printed assumptions, split at the first ' : '."""
    at = F.instr(column, " : ")
    return lines.filter(at > 0).select(F.btrim(F.substring_index(column, " : ", 1)).alias("axiom"), F.btrim(F.substr(column, at + 3)).alias("type"))
