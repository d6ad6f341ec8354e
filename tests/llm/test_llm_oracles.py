"""Queries against their SQL in DuckDB, and what the query adds to its operator."""

import os

import duckdb
import pytest

from recallgrid.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    df = queries.QUERIES[name](spark, sf)
    cur = c.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    told = lambda x: round(x, 12) if isinstance(x, float) else x
    rows = lambda data: sorted((tuple(map(told, r)) for r in data), key=str)
    assert rows(df.select(*cols).collect()) == rows(cur.fetchall())
