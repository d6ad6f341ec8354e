"""Lists chained by single sets are compared list by list, not as one region; frequent shingles come last in large tables too."""

import random

import numpy as np
import pytest

from recallgrid.llm import ngram_join


def test_chained_lists_are_no_region(spark, monkeypatch):
    rng = random.Random(3)
    words = iter(f"w{i}" for i in range(10**6))
    passages = [[next(words) for _ in range(40)] for _ in range(20)]
    texts = []
    for i in range(120):  # each passage stands in about 12 texts, and the passages chain all texts together
        a, b = rng.sample(range(20), 2)
        texts.append(passages[a] + passages[b])
    texts += [t[:-3] + [next(words) for _ in range(3)] for t in texts[:15]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [set(ngram_join.shingles(t).tolist()) for _, t in rows]
    parent = {}
    for i, x in enumerate(sets):
        ngram_join.root(parent, i)
        for j in range(i):
            both = len(x & sets[j])
            if both and ngram_join.DEN * both >= ngram_join.NUM * (len(x) + len(sets[j]) - both):
                p, q = ngram_join.root(parent, i), ngram_join.root(parent, j)
                parent[max(p, q)] = min(p, q)
    want = {i: ngram_join.root(parent, i) for i in range(len(rows))}
    seated, with_texts = [], ngram_join.with_texts
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 1000)
    monkeypatch.setattr(ngram_join, "with_texts", lambda seats, docs, reps: seated.append(seats.count()) or with_texts(seats, docs, reps))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < len(rows)
    assert sum(seated) < 3 * len(rows)  # a region of all texts took each of them about twenty times


@pytest.mark.parametrize("kept", [1 << 21, 1 << 14])
def test_frequent_cells_are_told_among_many(spark, monkeypatch, kept):
    monkeypatch.setattr(ngram_join, "KEPT_CELLS", kept)
    rng = np.random.default_rng(5)
    often = np.unique(rng.integers(0, 1 << ngram_join.CELL_BITS, 500, dtype=np.uint32))
    once = rng.integers(0, 1 << ngram_join.CELL_BITS, 1_000_000, dtype=np.uint32)
    tasks = [np.concatenate([x, np.repeat(often, 10)]) for x in np.split(once, 4)]
    packed = [(b, bytearray(data)) for t in tasks for b, data in ngram_join.pack_cells(t)]
    order = ngram_join.Order(*ngram_join.global_order(spark.createDataFrame(packed, "block int, cells binary")))
    shift = np.uint64(64 - ngram_join.CELL_BITS)
    low, high = order.level(once.astype(np.uint64) << shift), order.level(often.astype(np.uint64) << shift)
    assert high.min() >= 21 and (low >= 21).mean() < 0.001
    assert order.total == sum(len(t) for t in tasks) and len(order.cells) <= kept
    b, data = ngram_join.pack_cells(tasks[0])[0]
    mine = np.sort(tasks[0][tasks[0] >> ngram_join.BLOCK_BITS == b])
    assert np.array_equal(ngram_join.unpack_cells(data), mine & np.uint32((1 << ngram_join.BLOCK_BITS) - 1))
