"""Every query with an oracle gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from theoremill.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        name = file.split(".")[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, FOLDER)
    theirs = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    assert rows_of(mine.columns, mine.collect()) == rows_of(columns, theirs.fetchall())
