"""Ranked full-text search: BM25 over weighted fields.

The collection is exploded into postings once; query terms are a literal list, so the filter reaches the
generator's output before anything is shuffled. Document lengths and document frequencies are aggregated in
the same pass; only matching postings and one statistics row per term are joined.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from theoremill.functions.texts import name_query, question_terms, search_terms

K1, B = 1.2, 0.75


def field_terms(docs: DataFrame, key: str, fields: Mapping[str, float]) -> DataFrame:
    """(key, term, weight): every term of every field with the field's weight."""

    def weighted(field: str, weight: float) -> Column:
        return F.transform(search_terms(F.coalesce(F.col(field), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("weight")))

    parts = [weighted(f, w) for f, w in fields.items()]
    return docs.select(key, F.flatten(F.array(*parts)).alias("terms"))


def bm25(docs: DataFrame, key: str, fields: Mapping[str, float], terms: Sequence[str], every: bool = False, limit: int | None = 50) -> DataFrame:
    """(key, score) of the documents with any (or ``every``) of the terms, best first, ties by key.

    A term's frequency is the sum of its fields' weights; a document's length the number of all its terms.
    No terms give an empty result.
    """
    wanted = list(dict.fromkeys(t for term in terms for t in _terms_of(term)))
    lists = field_terms(docs, key, fields).withColumn("length", F.size("terms"))
    stats = lists.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    hits = lists.select(key, "length", F.explode(F.filter("terms", lambda t: t.term.isin(wanted))).alias("t")).groupBy(key, "length", "t.term").agg(F.sum("t.weight").alias("tf"))
    df = F.broadcast(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # one row per query term
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / float(stats.mean or 1))
    idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = hits.join(df, "term").groupBy(key).agg(F.sum(idf * F.col("tf") * (K1 + 1) / norm).alias("score"), F.count(F.lit(1)).alias("matched"))
    if every:
        scored = scored.filter(F.col("matched") == len(wanted))
    scored = scored.select(key, F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(limit) if limit else scored


def _terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


#: Weights of the declaration's fields and of the textbook's.
DECLARATION_FIELDS = {"name": 10.0, "statement": 1.0, "module": 5.0}
CHUNK_FIELDS = {"text": 1.0, "section_title": 10.0, "chapter": 10.0}


def search_by_name(declarations: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Declarations by name: id, name, module, kind, score (1 for the best), in order."""
    terms, every = name_query(query)
    hits = bm25(declarations, "id", DECLARATION_FIELDS, terms, every, limit)
    best = hits.agg(F.max("score").alias("best"))
    scored = hits.crossJoin(F.broadcast(best)).select("id", F.round(F.col("score") / F.col("best"), 6).alias("score"))  # one row
    return declarations.select("id", "name", "module", "kind").join(F.broadcast(scored), "id").orderBy(F.desc("score"), "id")  # at most `limit` rows


def search_chunks(chunks: DataFrame, question: str, limit: int = 20, volume: str | None = None) -> DataFrame:
    """Textbook sections for a question, of one volume or all."""
    rows = chunks.filter(F.col("volume") == volume) if volume else chunks
    return bm25(rows, "id", CHUNK_FIELDS, question_terms(question), False, limit)
