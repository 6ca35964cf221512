"""Queries of name, symbol, text and vector search over declarations, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremill.functions import names, scores, texts
from theoremill.operators import fusion, search, symbols
from theoremill.runtime import latest, read_table

NAME, QUESTION = "Lattice.compl", "How does induction rewrite the lattice?"
SYMBOLS = ("Sundry.Init.hemnorol", "Pactum.Init.lanost")
WEIGHTS = {"size": 2.0, "symbols": 0.5, "name": 0.0}


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row of each declaration, with its symbols as an array."""
    rows = latest(read_table(spark, sf, "declarations"), "id", ["indexed_at"])
    return rows.withColumn("symbols", symbols.symbol_array("symbol_set"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return latest(read_table(spark, sf, "chunks"), "id", ["built_at"])


def search_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_by_name(declarations(spark, sf), NAME)


def search_chunks_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_chunks(chunks(spark, sf), QUESTION)


def search_and_terms(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(declarations(spark, sf), "id", {"name": 1}, ["compl", "lattice"], True, None).select("id")


def search_or_terms(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(declarations(spark, sf), "id", {"name": 1}, ["lattice", "tapes"], False, None).select("id")


def list_modules(spark: SparkSession, sf: str) -> DataFrame:
    rows = declarations(spark, sf).filter(F.col("module").startswith("Sundry."))
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("n"))


def provable_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = declarations(spark, sf).filter(F.col("kind").isin(*names.PROVABLE) & (F.col("has_proof_body") == 1) & F.col("module").startswith("Lumeth"))
    return rows.select("id", "name", "module", "kind").orderBy("module", "name")


def symbol_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.frequencies(symbols.postings(declarations(spark, sf)))


def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.postings(declarations(spark, sf))


def suffix_index(spark: SparkSession, sf: str) -> DataFrame:
    """Suffixes that only one declaration's name has."""
    table = symbols.suffix_table(declarations(spark, sf).select(F.col("name").alias("symbol")))
    return table.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("symbol")).filter("n = 1").select("suffix", "symbol")


def resolve_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Every symbol of a symbol set resolved to a declaration."""
    rows = declarations(spark, sf)
    used = symbols.postings(rows).select(F.col("symbol").alias("name"))
    return symbols.resolve_names(used, rows.select(F.col("name").alias("symbol")))


def mepo_select(spark: SparkSession, sf: str) -> DataFrame:
    index = symbols.postings(declarations(spark, sf))
    wanted = spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")
    return symbols.select_relevant(index, symbols.frequencies(index), wanted, p=0.3, rounds=2).select("id", F.round("relevance", 6).alias("relevance"), "round")


def search_by_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.search_by_symbols(declarations(spark, sf), ("hemnorol", *SYMBOLS[1:], "Torvane.Init.lemxan"))


def jaccard_rank(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.jaccard_ranking(declarations(spark, sf), ("Sundry.Init.hemnorol", "Pactum.Init.lanost", "Torvane.Init.lemxan"))


def _channels(spark: SparkSession, sf: str) -> DataFrame:
    """Three ranked lists of all declarations: by size, by number of symbols, by name length."""
    rows = declarations(spark, sf).select("id", F.col("node_count").alias("size"), F.size("symbols").alias("symbols"), F.length("name").alias("name"))
    long = rows.unpivot("id", ["size", "symbols", "name"], "channel", "score").filter("score IS NOT NULL")
    return symbols.rank(long, channel="channel")


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Of the first 100 of each list, as its SQL has it; :func:`rrf_fuse_whole` fuses the whole lists."""
    return fusion.fuse(_channels(spark, sf).filter("rank <= 100"), limit=50)


def rrf_fuse_whole(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(_channels(spark, sf), limit=50)


def weighted_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Of the first 100 of each list, as its SQL has it; :func:`weighted_rrf_whole` fuses the whole lists."""
    return fusion.fuse(_channels(spark, sf).filter("rank <= 100"), weights=WEIGHTS, limit=50)


def weighted_rrf_whole(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(_channels(spark, sf), weights=WEIGHTS, limit=50)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The rows most similar to embedding 1, of the 64-dimensional embeddings."""
    rows = read_table(spark, sf, "embeddings")
    query = rows.filter("vec_id = 1").select("embedding").first()
    return fusion.vector_top(rows, "vec_id", "embedding", query[0] if query else [0.0] * 64, 20)


def size_filter(spark: SparkSession, sf: str) -> DataFrame:
    return declarations(spark, sf).filter(scores.size_ratio_ok(30, F.col("node_count"))).select("id", "node_count")


def type_expression_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = declarations(spark, sf).filter("type_expr is not null")
    return rows.select("id", F.array_join(texts.type_terms("type_expr"), " ").alias("terms"))


def symbol_weights(spark: SparkSession, sf: str) -> DataFrame:
    return symbol_frequency(spark, sf).select("symbol", F.round(scores.symbol_weight(F.col("freq")), 6).alias("weight"))


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Sections by question text and by similarity to section 1's vector."""
    vectors = latest(read_table(spark, sf, "education_embeddings"), "chunk_id", ["embedded_at"]).withColumnRenamed("chunk_id", "id")
    sound = vectors.filter((F.size("vector") == 384) & ~F.exists("vector", F.isnan))
    query = sound.orderBy("id").select("vector").first()
    near = fusion.vector_top(sound, "id", "vector", query[0] if query else [0.0] * 384, 40)
    hits = search.search_chunks(chunks(spark, sf), QUESTION, 40)
    return fusion.hybrid(hits, near, "id", 10)


def chapter_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of evaluation questions whose chapter is among the sections sharing most terms with the question."""
    rows = chunks(spark, sf).select("id", "chapter", F.array_distinct(texts.search_terms(F.concat_ws(" ", "chapter", "section_title"))).alias("terms"))
    asked = read_table(spark, sf, "eval_items").select(F.col("item_id").alias("qid"), "expected_chapter", F.array_distinct(texts.search_terms("query")).alias("terms"))
    a = rows.select("id", "chapter", F.explode("terms").alias("term"))
    q = asked.select("qid", "expected_chapter", F.explode("terms").alias("term"))
    hits = a.join(q, "term").groupBy("qid", "id", "chapter", "expected_chapter").agg(F.count(F.lit(1)).alias("score"))
    ranked = symbols.rank(hits, channel="qid").withColumn("hit", F.col("chapter") == F.col("expected_chapter"))
    return fusion.recall_at(ranked, asked)


def fusion_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of three fusion settings; the relevant ones are the ten declarations of most symbols."""
    ranked = _channels(spark, sf).withColumn("qid", F.lit(1))
    truth = symbols.rank(declarations(spark, sf).select("id", F.size("symbols").alias("score"))).filter("rank <= 10").select(F.lit(1).alias("qid"), "id")
    grid = [(60, {"size": 1.0, "symbols": 1.0, "name": 1.0}), (10, {"size": 2.0, "symbols": 0.0, "name": 1.0}), (60, {"size": 0.0, "symbols": 1.0, "name": 0.0})]
    truth_queries = fusion.sweep(ranked, truth.groupBy("qid", "id").agg(F.lit(1).alias("x")).select("qid", "id"), grid)
    return truth_queries


def decl_sql(extra: str = "") -> str:
    """The latest row of each declaration, as CTE ``d`` with the list ``symbols``."""
    return f"""
d AS (
  SELECT * EXCLUDE (r), coalesce(list_distinct(list_filter(list_transform(
      CASE WHEN regexp_matches(symbol_set, '^\\s*\\[', 's') AND json_valid(symbol_set) THEN from_json(symbol_set, '["VARCHAR"]') END,
      lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x IS NOT NULL AND x <> '')), []) AS symbols
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS r FROM declarations WHERE id IS NOT NULL) WHERE r = 1
){extra}"""


def _latest(table: str, key: str, at: str) -> str:
    return f"(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC NULLS LAST) AS r FROM {table} WHERE {key} IS NOT NULL) WHERE r = 1)"


def _terms(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda x: x <> '')"


def _bm25(fields: dict[str, float], terms: list[str], every: bool = False) -> str:
    """CTEs from table ``docs`` (id and fields) to ``hits`` (id, score)."""
    lists = " || ".join(f"list_transform({_terms(f'coalesce({f}, {chr(39) * 2})')}, lambda x: {{'t': x, 'w': {float(w)}}})" for f, w in fields.items())
    wanted = ", ".join(f"'{t}'" for t in terms)
    having = f"HAVING count(*) = {len(terms)}" if every else ""
    return f"""
lists AS (SELECT id, {lists} AS l FROM docs),
stats AS (SELECT count(*) AS n, avg(len(l)) AS mean FROM lists),
tf AS (SELECT id, len, t.t AS term, sum(t.w) AS tf FROM (SELECT id, len(l) AS len, unnest(l) AS t FROM lists) WHERE t.t IN ({wanted}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
hits AS (
  SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM tf JOIN df USING (term), stats GROUP BY id {having}
)"""


_CHANNELS = """,
long AS (
  SELECT id, 'size' AS channel, node_count AS score FROM d WHERE node_count IS NOT NULL
  UNION ALL SELECT id, 'symbols', len(symbols) FROM d UNION ALL SELECT id, 'name', length(name) FROM d
),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, id) AS rank FROM long) WHERE rank <= 100)"""

_MEPO = f"""
WITH {decl_sql()},
p AS (SELECT id, unnest(symbols) AS symbol FROM d),
w AS (SELECT id, symbol, 1 + 2 / log2(freq + 1) AS w FROM p JOIN (SELECT symbol, count(*) AS freq FROM p GROUP BY symbol) USING (symbol)),
s0 AS (SELECT unnest({list(SYMBOLS)}) AS symbol),
r1 AS (SELECT id, sum(CASE WHEN symbol IN (SELECT symbol FROM s0) THEN w ELSE 0 END) / sum(w) AS relevance FROM w GROUP BY id),
b1 AS (SELECT * FROM r1 WHERE relevance >= 0.3),
s1 AS (SELECT symbol FROM s0 UNION SELECT symbol FROM p WHERE id IN (SELECT id FROM b1)),
r2 AS (SELECT id, sum(CASE WHEN symbol IN (SELECT symbol FROM s1) THEN w ELSE 0 END) / sum(w) AS relevance FROM w GROUP BY id),
b2 AS (SELECT * FROM r2 WHERE relevance >= 0.3 / 2.4 AND id NOT IN (SELECT id FROM b1) AND EXISTS (SELECT 1 FROM b1))
SELECT id, round(relevance, 6) AS relevance, 1 AS round FROM b1 UNION ALL SELECT id, round(relevance, 6), 2 FROM b2"""

QUERIES = {
    f.__name__: f
    for f in (
        search_by_name, search_chunks_bm25, search_and_terms, search_or_terms, list_modules, provable_filter, symbol_frequency, inverted_index, suffix_index,
        resolve_symbols, mepo_select, search_by_symbols, jaccard_rank, rrf_fuse, rrf_fuse_whole, weighted_rrf, weighted_rrf_whole, vector_topk, size_filter, type_expression_terms, symbol_weights,
        hybrid_search, chapter_recall, fusion_sweep,
    )
}

_EMB = "list_aggregate(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)), 'sum')"
_QUESTION = ["induction", "rewrite"]

ORACLES = {
    "search_by_name": f"WITH {decl_sql()}, docs AS (SELECT id, name, statement, module FROM d), {_bm25({'name': 10, 'statement': 1, 'module': 5}, ['lattice', 'compl'], True)}, top AS (SELECT * FROM hits ORDER BY score DESC, id LIMIT 50) SELECT d.id, name, module, kind, round(score / (SELECT max(score) FROM top), 6) AS score FROM top JOIN d USING (id)",
    "search_chunks_bm25": f"WITH docs AS {_latest('chunks', 'id', 'built_at')}, {_bm25({'text': 1, 'section_title': 10, 'chapter': 10}, _QUESTION)} SELECT id, score FROM hits ORDER BY score DESC, id LIMIT 20",
    "search_and_terms": f"WITH {decl_sql()}, t AS (SELECT id, {_terms('name')} AS l FROM d) SELECT id FROM t WHERE list_contains(l, 'compl') AND list_contains(l, 'lattice')",
    "search_or_terms": f"WITH {decl_sql()}, t AS (SELECT id, {_terms('name')} AS l FROM d) SELECT id FROM t WHERE list_contains(l, 'lattice') OR list_contains(l, 'tapes')",
    "list_modules": f"WITH {decl_sql()} SELECT module, count(*) AS n FROM d WHERE starts_with(module, 'Sundry.') GROUP BY module",
    "provable_filter": f"WITH {decl_sql()} SELECT id, name, module, kind FROM d WHERE kind IN ('lemma', 'theorem', 'instance', 'definition') AND has_proof_body = 1 AND starts_with(module, 'Lumeth')",
    "symbol_frequency": f"WITH {decl_sql()} SELECT symbol, count(*) AS freq FROM (SELECT unnest(symbols) AS symbol FROM d) GROUP BY symbol",
    "inverted_index": f"WITH {decl_sql()} SELECT id, unnest(symbols) AS symbol FROM d",
    "suffix_index": f"WITH {decl_sql()}, s AS (SELECT name, string_split(name, '.') AS p FROM d), t AS (SELECT name, array_to_string(p[k:], '.') AS suffix FROM s, unnest(generate_series(2, len(p))) AS g(k)) SELECT suffix, min(name) AS symbol FROM t GROUP BY suffix HAVING count(*) = 1",
    "resolve_symbols": f"WITH {decl_sql()}, s AS (SELECT name, string_split(name, '.') AS p FROM d), t AS (SELECT name, array_to_string(p[k:], '.') AS suffix FROM s, unnest(generate_series(2, len(p))) AS g(k)), u AS (SELECT suffix, min(name) AS x FROM t GROUP BY suffix HAVING count(*) = 1), n AS (SELECT DISTINCT unnest(symbols) AS name FROM d) SELECT n.name, coalesce(e.name, st.name, u.x) AS symbol FROM n LEFT JOIN d e ON e.name = n.name LEFT JOIN d st ON st.name = 'Stdlib.' || n.name LEFT JOIN u ON u.suffix = n.name",
    "mepo_select": _MEPO,
    "jaccard_rank": f"WITH {decl_sql()}, j AS (SELECT id, len(list_intersect(symbols, q)) AS s, len(symbols) + 3 - len(list_intersect(symbols, q)) AS u FROM d, (SELECT ['Sundry.Init.hemnorol', 'Pactum.Init.lanost', 'Torvane.Init.lemxan'] AS q)) SELECT id, round(s / u, 6) AS score FROM j WHERE s > 0 ORDER BY score DESC, id LIMIT 50",
    "rrf_fuse": f"WITH {decl_sql(_CHANNELS)} SELECT id, score FROM (SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, min(rank) AS f FROM ranked GROUP BY id) ORDER BY score DESC, f, id LIMIT 50",
    "weighted_rrf": f"WITH {decl_sql(_CHANNELS)} SELECT id, score FROM (SELECT id, round(sum(CASE channel WHEN 'size' THEN 2.0 ELSE 0.5 END / (60 + rank)), 6) AS score, min(rank) AS f FROM ranked WHERE channel <> 'name' GROUP BY id) ORDER BY score DESC, f, id LIMIT 50",
    "vector_topk": f"SELECT e.vec_id, round({_EMB} / sqrt(list_aggregate(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x), 'sum') * list_aggregate(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x), 'sum')), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY cosine DESC, e.vec_id LIMIT 20",
    "size_filter": f"WITH {decl_sql()} SELECT id, node_count FROM d WHERE greatest(30, node_count) / greatest(least(30, node_count), 1) <= 1.2",
    "symbol_weights": f"WITH {decl_sql()} SELECT symbol, round(1 + 2 / log2(count(*) + 1), 6) AS weight FROM (SELECT unnest(symbols) AS symbol FROM d) GROUP BY symbol",
    "chapter_recall": f"""WITH c AS {_latest('chunks', 'id', 'built_at')}, a AS (SELECT id, chapter, unnest(list_distinct({_terms("concat_ws(' ', chapter, section_title)")})) AS term FROM c),
q AS (SELECT item_id AS qid, expected_chapter, unnest(list_distinct({_terms('query')})) AS term FROM eval_items),
h AS (SELECT qid, id, chapter, expected_chapter, count(*) AS score FROM a JOIN q USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM h),
f AS (SELECT qid, min(rank) AS first FROM r WHERE chapter = expected_chapter GROUP BY qid)
SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT DISTINCT item_id AS qid FROM eval_items) LEFT JOIN f USING (qid), (SELECT unnest([1, 3, 5]) AS k) GROUP BY k""",
}
