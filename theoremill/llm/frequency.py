"""Frequency of every distinct term, by range-partitioned external sort and run-length scanning.

(term, record) pairs are range-partitioned by both columns, so a term that a third of all records hold is
spread over many partitions; Spark's external sort orders each partition and spills; one streaming pass
counts runs. A pair lies in one partition only, so adding up the partial counts of a term that crosses a
partition border is exact.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.runtime import BLANKS, latest, strip


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_terms(text: str | None) -> Counter[str]:
    """The stripped, non-empty strings of a JSON array and how often it holds each.

    Null, anything that is no well-formed JSON array, and entries that are no strings count for nothing.
    """
    try:
        entries = json.loads(text, parse_int=lambda _: None, parse_constant=_no_constant) if text else None
    except (ValueError, RecursionError):
        entries = None
    if not isinstance(entries, list):
        return Counter()
    terms = (t for e in entries if isinstance(e, str) and (t := e.strip(BLANKS)))
    return Counter(t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for t in terms)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, JSON array) -> (term, record, n), already added up within the record."""
    for b in batches:
        counts = [parse_terms(t) for t in b.column(1).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
        terms = pa.array([t for c in counts for t in c], pa.string())
        yield pa.RecordBatch.from_arrays([terms, b.column(0).take(at), pa.array([n for c in counts for n in c.values()], pa.int64())], ["term", "record", "n"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, record, n) in order -> (term, freq, records), one row per run; the last run stays open until
    the next batch shows whether it goes on."""
    open_term, open_record, freq, records = None, None, 0, 0

    def batch(terms: pa.Array, freqs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(freqs, pa.int64()), pa.array(counts, pa.int64())], ["term", "freq", "records"])

    for b in batches:
        if not b.num_rows:
            continue
        term, record, n = b.column("term"), b.column("record"), b.column("n").to_numpy(zero_copy_only=False)
        new_term = np.ones(b.num_rows, bool)
        new_term[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        new_record = new_term.copy()
        new_record[1:] |= pc.not_equal(record[1:], record[:-1]).to_numpy(zero_copy_only=False)
        first = term[0].as_py()
        if open_term is not None and first == open_term:
            new_record[0] = record[0].as_py() != open_record
        starts = np.flatnonzero(new_term)
        freqs, counts = np.add.reduceat(n, starts), np.add.reduceat(new_record.astype(np.int64), starts)
        runs = term.take(pa.array(starts))
        if open_term is not None and first == open_term:
            freqs[0] += freq
            counts[0] += records
        elif open_term is not None:
            yield batch(pa.array([open_term]), np.array([freq]), np.array([records]))
        if len(starts) > 1:
            yield batch(runs[:-1], freqs[:-1], counts[:-1])
        open_term, open_record, freq, records = runs[-1].as_py(), record[-1].as_py(), int(freqs[-1]), int(counts[-1])
    if open_term is not None:
        yield batch(pa.array([open_term]), np.array([freq]), np.array([records]))


def run_lengths(pairs: DataFrame) -> DataFrame:
    """(term, freq, records), up to one row per term and partition, of ``pairs`` (term, record, n).

    ``n`` says how often the record holds the term; a pair may come in several rows. Rows with a null term
    or record are left out.
    """
    return (
        pairs.filter("term is not null and record is not null")
        .select("term", F.col("record").cast("long"), F.col("n").cast("long"))
        .repartitionByRange("term", "record")
        .sortWithinPartitions("term", "record")
        .mapInArrow(_scan, "term string, freq long, records long")
    )


def symbol_frequencies(declarations: DataFrame, recorded: DataFrame, rare: int = 2, common: float = 0.1) -> DataFrame:
    """For every symbol of declarations.symbol_set or symbol_freq.symbol: ``freq`` (occurrences), ``records``
    (declarations that hold it), ``recorded`` (sum over shards of the latest recorded freq, null if none),
    ``unreliable`` (recorded differs from records) and ``mark``: 'rare' in at most ``rare`` declarations,
    'common' in more than ``common`` of all, else null.

    Of rows with one id the latest indexed_at counts (null is oldest); rows with a null id are left out.
    Symbols are stripped; null and empty ones ignored. Empty tables give an empty result.
    """
    current = latest(declarations.select("id", "indexed_at", "symbol_set"), "id", ["indexed_at"])
    total = declarations.filter("id is not null").select("id").distinct().count()
    pairs = current.select(F.col("id").cast("long"), "symbol_set").mapInArrow(_pairs, "term string, record long, n long")
    listed = (
        recorded.select("shard", strip("symbol").alias("term"), "counted_at", F.col("freq").cast("long").alias("freq"))
        .filter("term <> ''")
        .groupBy("term", "shard")
        .agg(F.max(F.struct("counted_at", "freq")).alias("m"))
        .groupBy("term")
        .agg(F.sum("m.freq").alias("recorded"))
        .select("term", F.lit(0).cast("long").alias("freq"), F.lit(0).cast("long").alias("records"), "recorded")
    )
    return (
        run_lengths(pairs)
        .withColumn("recorded", F.lit(None).cast("long"))
        .unionByName(listed)
        .groupBy(F.col("term").alias("symbol"))
        .agg(F.sum("freq").alias("freq"), F.sum("records").alias("records"), F.max("recorded").alias("recorded"))
        .withColumn("unreliable", ~F.col("recorded").eqNullSafe(F.col("records")))
        .withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * total, "common"))
    )
