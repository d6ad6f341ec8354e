"""Catalogue queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from recallgrid.plans import catalog


@pytest.fixture(scope="module")
def sql(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    return c


def told(v):
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


def rows(data, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(told(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, sql, name):
    df = catalog.QUERIES[name](spark, sf)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert got
    if name in catalog.ORACLES:
        cur = sql.execute(catalog.ORACLES[name])
        data = cur.fetchall()
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows(data, cols)
