import random

import numpy as np
import pytest

import theoremill.llm.leaks as module
from theoremill.llm.leaks import Words, leaks, tile

ITEMS = "item_id long, query string, passage string, doc string"
DOCS = "doc_id long, text string, part int, words int"


def brute_tiles(doc, item, least):
    """Greedy string tiling straight from its definition."""
    used_d, used_i, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not used_i[i + n] and not used_d[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (j, i, n)
        if best is None:
            return out
        j, i, n = best
        used_i[i : i + n] = [True] * n
        used_d[j : j + n] = [True] * n
        out.append(best)


@pytest.mark.parametrize("seed", range(30))
def test_tiles(seed):
    r = random.Random(seed)
    doc, item = (np.array([r.randint(0, 3 if seed % 2 else 8) for _ in range(r.randint(0, n))], np.uint64) for n in (60, 25))
    assert sorted(n for _, _, n in tile(doc, item, 3)) == sorted(n for _, _, n in brute_tiles(doc.tolist(), item.tolist(), 3))


def test_words():
    words = Words()
    assert list(words("The KK-x9 Iİ")) == list(words("the k x9 i")) and len(words(None)) == len(words("—")) == 0


def test_rows(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(24))
    moved = " ".join(f"p{i}" for i in [*range(12, 23), *range(0, 11)])
    items = [(1, "short one", passage, ""), (2, "What is it?", None, ""), (3, None, "", ""), (4, "—", " ", ""), (None, "short one", None, ""), (1, "short one", passage, "")]
    docs = [
        (1, "x " + passage.upper().replace(" ", " - ") + " y", 0, 0),
        (2, " ".join(passage.split()[3:15]), 0, 0),
        (3, " ".join(passage.split()[3:14]), 0, 0),
        (4, "so what\nis IT then", 0, 0),
        (5, "one short", 0, 0),
        (6, moved, 0, 0),
        (7, None, 0, 0),
        (8, "", 0, 0),
        (9, "a Short one. " * 3, 0, 0),
    ]
    for blocks in (50_000, 1):
        monkeypatch.setattr(module, "BLOCK_ITEMS", blocks)
        found = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
        assert {(r.doc_id, r.item_id, r.part) for r in found if r.verbatim} == {(1, 1, "passage"), (2, 1, "passage"), (4, 2, "query"), (9, 1, "query")}
        assert {(r.doc_id, r.item_id) for r in found if not r.verbatim} == {(6, 1)} and len(found) == 5
    assert leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    assert leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_repetitive_texts_have_the_same_tiles(seed, monkeypatch):
    r = random.Random(seed)
    doc, item = (np.array([r.randint(0, 3 if seed % 2 else 1) for _ in range(r.randint(0, n))], np.uint64) for n in (60, 25))
    monkeypatch.setattr(module, "MOST_MATCHES", -10_000)
    assert sorted(n for _, _, n in tile(doc, item, 3)) == sorted(n for _, _, n in brute_tiles(doc.tolist(), item.tolist(), 3))


def test_long_repeated_boilerplate():
    doc, item = np.full(40_000, 7, np.uint64), np.full(3_000, 7, np.uint64)
    assert tile(doc, item, 8) == [(0, 0, 3_000)]


def test_more_items_than_a_block_read_the_documents_once(spark):
    items = spark.range(200_000).selectExpr("id AS item_id", "concat('what about item ', id % 100000) AS query", "concat_ws(' ', transform(sequence(0, 19), k -> concat('w', id % 100000, 'x', k))) AS passage")
    docs = [(i, "so " + " ".join(f"w{i * 7}x{k}" for k in range(2, 16)) + f" and what about item {i}", 0, 0) for i in range(50)]
    table = spark.createDataFrame(docs, DOCS)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    found = leaks(table.mapInArrow(count, table.schema), items).collect()
    assert reads.value == len(docs)
    assert {(r.doc_id, r.item_id, r.part) for r in found if r.verbatim} == {(i, j + 100_000 * k, p) for i in range(50) for k in (0, 1) for j, p in ((7 * i, "passage"), (i, "query"))}
