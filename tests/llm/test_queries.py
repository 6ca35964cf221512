"""Queries that SQL can express give what DuckDB gives; the others run over whole small tables."""

import os

import duckdb
import pytest

from theoremill.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    mine = QUERIES[name](spark, FOLDER)
    rows = mine.collect()
    if name not in ORACLES:
        assert rows
        return
    duck = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        duck.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    theirs = duck.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(mine.columns)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted(theirs.fetchall(), key=repr)
