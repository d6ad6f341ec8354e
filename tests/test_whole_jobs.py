"""Jobs that once were cut short, against brute force and SQL without the cut."""

import os
import random

import duckdb

from recallgrid.operators import retrieve
from recallgrid.plans import catalog


def budget_fold(cands, top_k, budget):
    used = picked = dropped = 0
    for _, _, t in sorted(cands):
        if picked >= top_k:
            break
        if used + t > budget:
            dropped += 1
        else:
            used, picked = used + t, picked + 1
    return used, picked, dropped


def test_budget_fold_reads_all_candidates(spark):
    rng = random.Random(5)
    rows = [(0, i, 0.9, 500) for i in range(60)] + [(0, 60 + i, 0.5, 100) for i in range(3)] + [(1, i, 0.9, 401) for i in range(70)]
    for q in range(2, 30):
        rows += [(q, i, rng.randrange(20) / 20, rng.choice((rng.randrange(1, 30), rng.randrange(300, 900)) if q % 2 else (rng.randrange(100, 450),))) for i in range(rng.randrange(1, 200))]
    scored = spark.createDataFrame(rows, "query_id long, item_id long, score double, tokens long")
    got = {r["query_id"]: (r["used"], r["picked"], r["dropped"]) for r in retrieve.select_in_budget(scored, 5, 400).collect()}
    assert got[0] == (300, 3, 60) and got[1] == (0, 0, 70)
    assert got == {q: budget_fold([(-s, i, t) for k, i, s, t in rows if k == q], 5, 400) for q in {r[0] for r in rows}}


def test_token_budget_query_has_no_rank_cap(spark, sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    whole = catalog.ORACLES["retrieve_token_budget"].replace(" WHERE rank <= 50", "")
    df = catalog.QUERIES["retrieve_token_budget"](spark, sf).select("query_id", "used", "picked", "dropped")
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(f"SELECT query_id, used, picked, dropped FROM ({whole})").fetchall())
