"""The block index against brute-force BM25: pruning, ties, repeated ids, batches of queries, kept segments, budgets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import index, retrieve

WORDS = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnp"]


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randrange(0, 40)
        rows.append((i, " ".join(WORDS[int(len(WORDS) * rng.random() ** 3)] for _ in range(size)) if i % 17 else None))
    rows += [(n + i, rows[5][1]) for i in range(30)]  # many equal texts: ties
    rows.append((5, "wak wbl wbl"))  # an id that recurs
    asked = [(100 + q, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 8))) + (" unheard" if q % 3 == 0 else "")) for q in range(12)] + [(200, ""), (201, None), (202, "nothing known")]
    return rows, asked


def brute(rows, asked):
    docs = [(i, (t or "").split()) for i, t in rows]
    n, avg = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = {}
    for _, ts in docs:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in asked:
        terms = list(dict.fromkeys((text or "").split()))
        idf = {t: math.log1p((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in terms}
        top = sum(2.5 * x for x in idf.values()) or 1.0
        found = []
        for i, ts in docs:
            raw = sum(idf[t] * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in terms if t in ts)
            if raw:
                found.append((round(min(1.0, raw / top), 4), i, len(ts)))
        out[q] = sorted(found, key=lambda x: (-x[0], x[1]))
    return out


def frames(spark, rows, asked):
    return spark.createDataFrame(rows, "id long, content string").repartition(5), spark.createDataFrame(asked, "query_id long, query string")


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(index, "BLOCK_ITEMS", 16)
    monkeypatch.setattr(index, "FIRST_BLOCKS", 2)


@pytest.mark.parametrize("most", [500_000, 9])
def test_search_against_brute_force(spark, small_blocks, monkeypatch, most):
    monkeypatch.setattr(index, "MOST_TERMS", most)
    rows, asked = corpus(1, 300)
    want = brute(rows, asked)
    got = index.search(*frames(spark, rows, asked), 4).collect()
    assert {r["query_id"] for r in got} == {q for q, found in want.items() if found}
    for q, found in want.items():
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["score"], r["item_id"]) for r in mine] == [(s, i) for s, i, _ in found[:4]]


def test_matches_keep_the_order_of_the_query(spark):
    items, asked = frames(spark, [(1, "beta alpha gamma"), (2, "delta")], [(1, "gamma alpha omega beta gamma")])
    (r,) = index.search(items, asked, 3).collect()
    assert r["matched"] == ["gamma", "alpha", "beta"]


def test_blocks_under_the_threshold_are_not_scored(spark, small_blocks):
    """One block holds the word asked for often; blocks where it is rare and texts are long stay unread."""
    rows = [(i, " ".join(["needle"] * 5 if i < 16 else ["needle"] + ["hay"] * 60)) for i in range(160)]
    items = spark.createDataFrame(rows, "id long, content string").coalesce(1)
    blocks = index.build(items).cache()
    asked = [(1, ["needle"])]
    batch = index.weigh(blocks, asked)
    bounds = sorted(r["bound"] for r in index.bounds(blocks, batch).collect())
    best = index.top_batch(blocks, batch, 3).collect()
    assert len(bounds) == 10 and min(r["score"] for r in best) > bounds[-2]


def test_counts_and_budget(spark, small_blocks):
    rows, asked = corpus(2, 200)
    want = brute(rows, asked)
    items, queries = frames(spark, rows, asked)
    got = {r["query_id"]: (r["n"], r["kept"], r["below"]) for r in index.score_counts(items, queries, 0.3).collect()}
    assert got == {q: (len(f), sum(s >= 0.3 for s, _, _ in f), sum(s < 0.3 for s, _, _ in f)) for q, f in want.items() if f}
    length = F.size(F.filter(F.split(F.coalesce("content", F.lit("")), " "), lambda x: x != ""))
    for k, budget in ((3, 12), (5, 60), (40, 30)):
        picked = {}
        for q, found in want.items():
            used = n = dropped = 0
            for _, _, size in found:
                if n >= k:
                    break
                if used + size > budget:
                    dropped += 1
                else:
                    used, n = used + size, n + 1
            if found:
                picked[q] = (used, n, dropped)
        out = index.budgeted(items, queries, k, budget, length, lambda c: retrieve.budget_state(c, k, budget)).collect()  # noqa: B023
        assert {r["query_id"]: (r["used"], r["picked"], r["dropped"]) for r in out} == picked


def test_appended_index_equals_a_rebuilt_one(spark, small_blocks, tmp_path):
    rows, asked = corpus(3, 240)
    items, queries = frames(spark, rows, asked)
    path = f"file://{tmp_path}/kept"
    told = lambda df: sorted(map(tuple, df.select("query_id", "item_id", "score", "rank").collect()))
    for part in range(3):
        index.append(spark, path, items.filter(F.col("id") % 3 == part))
    whole = told(index.search(items, queries, 6))
    assert told(index.top_k(index.opened(spark, path), queries, 6)) == whole
    # a segment that was written but not made live is not read
    index.build(items).write.partitionBy("bucket").parquet(f"{path}/segments/segment=sunfinished")
    assert told(index.top_k(index.opened(spark, path), queries, 6)) == whole
    index.compact(spark, path, f"file://{tmp_path}/one")
    assert told(index.top_k(index.opened(spark, f"file://{tmp_path}/one"), queries, 6)) == whole
    # only the buckets of the terms asked for are read
    plan = index.of_terms(index.opened(spark, path), {"wak"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:400]


def test_empty_tables(spark):
    items, queries = frames(spark, [(1, "wak")], [(1, "wak")])
    assert index.search(items.filter("false"), queries, 3).collect() == []
    assert index.search(items, queries.filter("false"), 3).collect() == []
    assert index.score_counts(items.filter("false"), queries, 0.1).collect() == []
