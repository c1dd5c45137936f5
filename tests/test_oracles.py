"""Every query with a DuckDB twin gives the twin's rows, on the smallest tables."""

import os

import duckdb
import pytest

from tests.conftest import DATA
from wickwork.queries import ORACLES, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def cell(x):
    if x is None or x != x:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return str(round(float(x), 7) + 0.0)
    return str(x)


def rows(names, table):
    return sorted(tuple(cell(r[n]) for n in sorted(names)) for r in table)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = [r.asDict() for r in got.collect()]
    if name not in ORACLES:
        assert got.columns
        return
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = want.columns
    assert rows(names, found) == rows(names, [dict(zip(names, r)) for r in want.fetchall()])


#: Queries that SQL cannot express; tests by hand hold them.
WITHOUT_TWIN: set[str] = set()


def test_no_query_is_without_twin():
    assert set(QUERIES) - WITHOUT_TWIN == set(ORACLES)
