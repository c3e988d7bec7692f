"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
from pathlib import Path

import duckdb
import pytest

from regionspark import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 7)
    return value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, oracle, name):
    frame = catalogue.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = oracle.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    assert got == want
