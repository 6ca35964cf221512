import datetime as dt

import numpy as np

from theoremill.llm.neighbours import nearest, similar_pairs
from theoremill.llm.partitions import top, unit
import theoremill.llm.neighbours as module

SCHEMA = "chunk_id long, vector array<float>, embedded_at timestamp, id int, part int"
DAY = dt.datetime(2024, 1, 1)


def vectors(n, width, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((40, width))
    return (centres[r.integers(0, 40, n)] + 0.7 * r.standard_normal((n, width))).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, DAY, 0, 0) for i, v in rows], SCHEMA)


def recall(spark, x, width, **options):
    found = nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), 10, width=width, **options).collect()
    sim = unit(x) @ unit(x).T
    np.fill_diagonal(sim, -2)
    true = top(sim, 10)
    got = {}
    for r in found:
        got.setdefault(r.id, set()).add(r.neighbour)
    assert len(found) == 10 * len(x) and all(len(g) == 10 for g in got.values())
    return sum(len(got[i] & set(true[i].tolist())) for i in range(len(x))) / (10 * len(x))


def test_recall_with_many_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "PART_ROWS", 100)
    assert recall(spark, vectors(3000, 32), 32) >= 0.95


def test_recall_with_parts_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "PART_ROWS", 1000)
    monkeypatch.setattr(module, "MAX_PARTS", 1)
    monkeypatch.setattr(module, "BLOCK_ROWS", 130)
    assert recall(spark, vectors(2000, 16), 16) > 0.99


def test_recall_with_a_second_level(spark, monkeypatch):
    monkeypatch.setattr(module, "PART_ROWS", 60)
    monkeypatch.setattr(module, "MAX_PARTS", 8)
    monkeypatch.setattr(module, "BLOCK_ROWS", 150)
    x = vectors(3000, 24)
    x[:1000] = x[0] + 0.05 * x[:1000]  # a dense region with a third of all
    assert recall(spark, x, 24) >= 0.9


def test_exact_with_all_parts_asked(spark, monkeypatch):
    monkeypatch.setattr(module, "PART_ROWS", 50)
    assert recall(spark, vectors(800, 16), 16, probes=1024) > 0.99


def test_copies_and_broken_vectors(spark):
    x = vectors(60, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[0].tolist()) for i in range(30)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [1.0] * 7), (205, [None] + [1.0] * 7), (None, x[1].tolist()), (206, [float("inf")] * 8)]
    rows += [(5, x[5].tolist())]
    found = {}
    for r in nearest(frame(spark, rows), 10, width=8).collect():
        found.setdefault(r.id, []).append((-r.cosine, r.neighbour))
    ids = [*range(60), *range(100, 130)]
    every = np.concatenate([x, np.repeat(x[:1], 30, 0)])
    sim = unit(every) @ unit(every).T
    assert sorted(found) == ids
    for k, i in enumerate(ids):
        assert len(found[i]) == 10
        best = sorted((-sim[k, j], ids[j]) for j in range(len(ids)) if j != k)[:10]
        assert np.allclose([c for c, _ in sorted(found[i])], [c for c, _ in best], atol=2e-3)
    assert sorted(n for _, n in found[0]) == list(range(100, 110))
    assert sorted(n for _, n in found[115]) == [0, *range(100, 109)]


def test_pairs_at_the_bound(spark):
    a = np.array([1.0, 0.0])
    at = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(1, a.tolist()), (2, at(0.8502)), (3, at(0.8498))]
    assert sorted(map(tuple, similar_pairs(frame(spark, rows), width=2).collect())) == [(1, 2), (2, 3)]


def test_empty(spark):
    assert nearest(frame(spark, []), width=2).count() == 0
    assert similar_pairs(frame(spark, [(1, [1.0, 0.0])]), width=2).count() == 0
