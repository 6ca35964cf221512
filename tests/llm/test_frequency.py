import datetime as dt
import random
from collections import Counter

import pytest

from theoremill.llm.frequency import parse_terms, run_lengths, symbol_frequencies

DAY = dt.datetime(2024, 1, 1)
DECLARATIONS = "id long, indexed_at timestamp, symbol_set string, symbol string"
RECORDED = "shard int, symbol string, freq long, counted_at timestamp"


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        (None, {}),
        ("", {}),
        ("[]", {}),
        ("n/a", {}),
        ('{"a": 1}', {}),
        ('["a", "b"', {}),
        ('["a"] x', {}),
        ("['a']", {}),
        ("[NaN]", {}),
        ('["a", " a\\t", "", null, 3, ["b"], "\\u03b1"]', {"a": 2, "α": 1}),
        ('["\\ud800x"]', {"�x": 1}),
        ("[" * 100_000, {}),
    ],
)
def test_parse(text, terms):
    assert parse_terms(text) == terms


def test_run_lengths_against_counts(spark):
    r = random.Random(3)
    rows = [(r.choice("hhhhhhabc") + ("x" * r.randint(0, 2)), r.randint(1, 40), r.randint(1, 3)) for _ in range(3000)]
    rows += [(None, 1, 1), ("q", None, 1)]
    freq, records = Counter(), {}
    for term, record, n in rows:
        if term is not None and record is not None:
            freq[term] += n
            records.setdefault(term, set()).add(record)
    found = run_lengths(spark.createDataFrame(rows, "term string, record long, n long")).groupBy("term").sum("freq", "records").collect()
    assert {t: (f, c) for t, f, c in found} == {t: (freq[t], len(records[t])) for t in freq}


def test_symbols(spark):
    rows = [(i, DAY, '["common", "pair"]' if i < 2 else '["common"]', "clash") for i in range(40)]
    rows += [(0, DAY - dt.timedelta(1), '["old"]', None), (0, None, '["older"]', None), (None, DAY, '["none"]', None), (41, DAY, None, None)]
    recorded = [(0, " common\n", 39, DAY), (0, "common", 1, DAY - dt.timedelta(1)), (1, "common", 1, DAY), (0, "gone", 7, None), (0, None, 1, DAY), (0, " ", 1, DAY), (0, "pair", None, DAY)]
    found = {r.symbol: tuple(r)[1:] for r in symbol_frequencies(spark.createDataFrame(rows, DECLARATIONS), spark.createDataFrame(recorded, RECORDED)).collect()}
    assert found == {"common": (40, 40, 40, False, "common"), "pair": (2, 2, None, True, "rare"), "gone": (0, 0, 7, True, "rare")}


def test_empty(spark):
    assert symbol_frequencies(spark.createDataFrame([], DECLARATIONS), spark.createDataFrame([], RECORDED)).count() == 0
