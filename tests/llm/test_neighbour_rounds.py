"""Where first windows are too narrow, wider ones are taken on the curves that rows were dealt to; rows are not dealt again."""

import numpy as np

from recallgrid.llm import curves


def test_windows_grow_on_curves_dealt_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((1500, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    made = []

    class Counted(curves.Curves):
        def __init__(self, sample, first, count):
            made.append((first, count))
            super().__init__(sample, first, count)

    looked, search = [], curves.window_search
    monkeypatch.setattr(curves, "Curves", Counted)
    monkeypatch.setattr(curves, "window_search", lambda dealt, k, windows, only, *a: looked.append((windows, only)) or search(dealt, k, windows, only, *a))
    got = {}
    for r in curves.nearest(df, window=48).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 1500, 50):
        s = curves.cosines(m[q], m)
        hits += len(got[q] & set([j for j in np.argsort(-s) if j != q][:5]))
    (tried, sample), (taken, every) = looked
    assert made == [(0, 8)] and len(sample) == 30 and every is None and len(taken) == 1 and taken[0] in tried and taken[0] > 48
    assert hits >= 0.9 * 150
