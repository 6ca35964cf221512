"""Queries of the training-data operators and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from theoremill.llm import encoding, frequency, garbled, leaks, neighbours, overlap, pieces, splits
from theoremill.runtime import latest, read_table, spread


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table, of repeated doc_ids the latest row."""
    documents = read_table(spark, sf, "documents").select("doc_id", "text", "source", "doc_kind", "added_at")
    return latest(spread(documents), "doc_id", ["added_at"])


def p1_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return frequency.symbol_frequencies(read_table(spark, sf, "declarations"), read_table(spark, sf, "symbol_freq"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_symbols(spark, sf).filter("mark is not null").select("symbol", "mark")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = overlap.split_overlaps(read_table(spark, sf, "tactic_dataset"))
    return pairs.selectExpr("least(train_id, other_id) AS pair_a", "greatest(train_id, other_id) AS pair_b")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(read_table(spark, sf, "tactic_dataset"), read_table(spark, sf, "duplicate_cluster"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(read_table(spark, sf, "education_embeddings")).selectExpr("a AS chunk_a", "b AS chunk_b")


def p4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf, "education_embeddings")).withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.torn_groups(read_table(spark, sf, "tactic_dataset"))


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.dataset_splits(read_table(spark, sf, "tactic_dataset"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = pieces.chunk_pieces(read_table(spark, sf, "chunks"), with_text=False)
    return found.filter("piece_no = 0").select("chunk_id", "item_no")


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.chunk_pieces(read_table(spark, sf, "chunks"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode(_documents(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).filter("verbatim").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(_documents(spark, sf), read_table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.garbled(_documents(spark, sf)).select("doc_id")


def p9_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.repair(_documents(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_symbols, p3_found, p3_report, p4_found, p4_nearest, p5_found, p5_splits, p6_found, p6_pieces, p7_ids, p8_found, p8_leaks, p9_found, p9_repaired)
}



def _latest(table: str, key: str, at: str) -> str:
    return f"(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC NULLS LAST) AS r FROM {table} WHERE {key} IS NOT NULL) WHERE r = 1)"


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13)"
_TOKENS = r"list_filter(string_split_regex({0}, '[ \t\r\n]+'), lambda x: x <> '')"

_SYMBOLS = f"""
WITH d AS {_latest('declarations', 'id', 'indexed_at')},
p AS (
  SELECT id, trim(t, {_BLANKS}) AS symbol FROM (
    SELECT id, unnest(CASE WHEN json_valid(symbol_set) AND json_type(symbol_set) = 'ARRAY' THEN from_json(symbol_set, '["VARCHAR"]') END) AS t FROM d)
  WHERE t IS NOT NULL AND trim(t, {_BLANKS}) <> ''
),
c AS (SELECT symbol, count(*) AS freq, count(DISTINCT id) AS records FROM p GROUP BY symbol),
f AS (
  SELECT symbol, sum(freq) AS recorded FROM (
    SELECT symbol, freq, row_number() OVER (PARTITION BY symbol, shard ORDER BY counted_at DESC NULLS LAST, freq DESC NULLS LAST) AS r
    FROM (SELECT shard, trim(symbol, {_BLANKS}) AS symbol, freq, counted_at FROM symbol_freq WHERE trim(symbol, {_BLANKS}) <> '')
  ) WHERE r = 1 GROUP BY symbol
),
s AS (
  SELECT symbol, coalesce(c.freq, 0) AS freq, coalesce(records, 0) AS records, CAST(recorded AS BIGINT) AS recorded FROM c FULL JOIN f USING (symbol)
),
m AS (
  SELECT *, recorded IS DISTINCT FROM records AS unreliable,
    CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM d) THEN 'common' END AS mark FROM s
)"""

_FILE = r"array_to_string(list_filter(string_split_regex(lower(trim(source_file, {0})), '[/\\]+'), lambda x: x <> '' AND x <> '.'), '/')".format(_BLANKS)
_AUTHOR = f"lower(trim(author, {_BLANKS}))"

_OVERLAPS = f"""
WITH d AS {_latest('tactic_dataset', 'pair_id', 'recorded_at')},
t AS (SELECT pair_id, split, list_distinct({_TOKENS.format('lower(state_text)')}) AS l FROM d WHERE state_text IS NOT NULL),
u AS (SELECT pair_id, split, len(l) AS n, unnest(l) AS t FROM t WHERE len(l) >= 15),
o AS (
  SELECT a.pair_id AS train_id, b.pair_id AS other_id FROM u a JOIN u b ON a.t = b.t AND a.split = 'train' AND b.split IN ('val', 'test')
  GROUP BY a.pair_id, b.pair_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))
)"""

#: The same in DuckDB's SQL. None for nearest vectors, new splits, pieces, ids and garbled text: SQL can't
#: express them, or not on whole tables; they are tested against brute force.
ORACLES: dict[str, str] = {
    "p1_found": f"{_SYMBOLS} SELECT symbol, mark FROM m WHERE mark IS NOT NULL",
    "p1_symbols": f"{_SYMBOLS} SELECT * FROM m",
    "p3_found": f"{_OVERLAPS} SELECT least(train_id, other_id) AS pair_a, greatest(train_id, other_id) AS pair_b FROM o",
    "p3_report": f"""{_OVERLAPS},
c AS (SELECT row_number() OVER () AS c, members FROM duplicate_cluster),
m AS (SELECT DISTINCT c, name FROM (SELECT c, unnest(members) AS name FROM c) WHERE name IS NOT NULL),
k AS (SELECT DISTINCT a.name AS x, b.name AS y FROM m a JOIN m b USING (c)),
j AS (
  SELECT b.split, b.project_id, other_id, (a.theorem_name, b.theorem_name) IN (SELECT (x, y) FROM k) AS known
  FROM o JOIN d a ON a.pair_id = train_id JOIN d b ON b.pair_id = other_id
)
SELECT split, project_id, count(*) AS pairs, count(DISTINCT other_id) AS records, count(*) FILTER (known) AS known FROM j GROUP BY ALL""",
    "p5_found": f"""
WITH RECURSIVE d AS {_latest('tactic_dataset', 'pair_id', 'recorded_at')},
v AS (
  SELECT pair_id, 'f:' || nullif({_FILE}, '') AS v FROM d WHERE nullif({_FILE}, '') IS NOT NULL
  UNION SELECT pair_id, 'a:' || {_AUTHOR} FROM d WHERE {_AUTHOR} NOT IN ('', 'unknown', 'n/a', '-')
  UNION SELECT pair_id, 't:' || theorem_name FROM d WHERE theorem_name IS NOT NULL
),
e AS (SELECT pair_id AS a, min(pair_id) OVER (PARTITION BY v) AS b FROM v),
e2 AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT pair_id AS a, pair_id AS b FROM d UNION SELECT r.a, e2.b FROM r JOIN e2 ON e2.a = r.b),
g AS (SELECT a AS pair_id, min(b) AS group_id FROM r GROUP BY a)
SELECT pair_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM g JOIN d USING (pair_id) GROUP BY group_id HAVING count(DISTINCT split) > 1)""",
    "p6_found": f"""
WITH d AS {_latest('chunks', 'id', 'built_at')},
i AS (SELECT id, [text] || coalesce(code_blocks, []) AS l FROM d)
SELECT id AS chunk_id, CAST(k - 1 AS INTEGER) AS item_no FROM i, unnest(generate_series(1, len(l))) AS g(k) WHERE len({_TOKENS.format('l[k]')}) > 400""",
    "p8_found": f"""
WITH d AS {_latest('documents', 'doc_id', 'added_at')},
w AS (SELECT doc_id, ' ' || trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) || ' ' AS t FROM d WHERE text IS NOT NULL),
i AS (
  SELECT item_id, string_split(trim(lower(regexp_replace(passage, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS p,
    trim(lower(regexp_replace(query, '[^A-Za-z0-9]+', ' ', 'g'))) AS q FROM eval_items
),
s AS (
  SELECT item_id, ' ' || array_to_string(p[k:k + 11], ' ') || ' ' AS s FROM i, unnest(generate_series(1, len(p) - 11)) AS g(k)
  UNION SELECT item_id, ' ' || q || ' ' FROM i WHERE q <> ''
)
SELECT DISTINCT doc_id, item_id FROM w JOIN s ON contains(w.t, s.s)""",
}
