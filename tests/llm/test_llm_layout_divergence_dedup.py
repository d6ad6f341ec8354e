"""Clustered layout, source divergence and semantic near duplicates against brute force, and their edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.llm import divergence, layout, semantic_dedup

DOCS = "doc_id long, text string, lang string, source string"


def brute_layout(rows, file_rows):
    """rows: (doc_id, four comparable keys)."""
    n = len(rows)
    coords = []
    for r in rows:
        coords.append(tuple(8 * sum(o[1 + i] < r[1 + i] for o in rows) // n for i in range(4)))
    z = [int("".join(format(c, "03b")[b] for b in range(3) for c in cs), 2) for cs in coords]
    order = sorted(range(n), key=lambda i: (z[i], rows[i][0]))
    file = {i: p // file_rows for p, i in enumerate(order)}
    bounds, members = {}, defaultdict(set)
    for i in range(n):
        members[file[i]].add(coords[i])
    for f, cs in members.items():
        bounds[f] = [(min(c[k] for c in cs), max(c[k] for c in cs)) for k in range(4)]
    reach = (0, 0, 1, 1)
    out = {}
    for p, i in enumerate(order):
        box = [(c - r, c + r) for c, r in zip(coords[i], reach)]
        touched = sum(all(lo <= hi2 and hi >= lo2 for (lo, hi), (lo2, hi2) in zip(b, box)) for b in bounds.values())
        matching = sum(any(all(lo <= c <= hi for c, (lo, hi) in zip(cs, box)) for cs in m) for m in members.values())
        out[rows[i][0]] = (z[i], p, file[i], touched, matching, ",".join(str(x) for b in bounds[file[i]] for x in b))
    return out


@pytest.mark.parametrize("seed,n,file_rows,id_ranges", [(1, 300, 10, 16), (2, 700, 50, 4), (3, 40, 7, 1024)])
def test_layout_against_brute_force(spark, seed, n, file_rows, id_ranges):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if rng.random() < 0.05 else "src" + str(0 if rng.random() < 0.33 else rng.randrange(9)) + ("é" if rng.random() < 0.1 else "")
        lang = rng.choice(["en", "en", "de", None, "Z", "ü"])
        text = None if rng.random() < 0.05 else "" if rng.random() < 0.1 else "é" * int(rng.lognormvariate(2, 1.5))
        rows.append((i * 3 if i % 7 else 10**12 + i, text, lang, source))
    key = lambda s: (s is not None, (s or "").encode())
    told = [(i, key(source), key(lang), -1 if text is None else len(text.encode()), zlib.crc32(str(i).encode()) % 365) for i, text, lang, source in rows]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"z": F.lit("clash"), "block": F.lit(1), "file": F.lit(2)}).repartition(5)
    length = F.coalesce(F.octet_length("text"), F.lit(-1))
    keys = [layout.text_key(F.col("source")), layout.text_key(F.col("lang")), layout.number_key(length), layout.number_key(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 365)]
    got = {r[0]: tuple(r)[1:] for r in layout.lay_out(docs, "doc_id", keys, [0, 0, 1, 1], file_rows, id_ranges).collect()}
    assert got == brute_layout(told, file_rows)


def test_layout_edge_cases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert layout.document_layout(empty).collect() == []
    again = spark.createDataFrame([(1, "a", "en", "s"), (1, "a", "en", "s"), (None, None, None, None)], DOCS)
    out = layout.document_layout(again).collect()
    assert sorted(r["position"] for r in out) == [0, 1, 2] and {r["file"] for r in out} == {0}
    assert all(r["files_touched"] == 1 and r["files_matching"] == 1 for r in out)
    with pytest.raises(ValueError):
        layout.lay_out(again, "doc_id", [layout.text_key(F.col("lang"))] * 6, [0] * 6)


def brute_divergence(rows, least, top):
    cnt, in_docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        ws = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        for w in ws:
            cnt[lang, source, w] += 1
        for w in set(ws):
            in_docs[lang, w] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in in_docs.items() if x == lang and n >= least]
        mine = sorted(s for x, s in groups if x == lang)
        v = len(kept)
        whole = {w: sum(cnt[lang, s, w] for s in mine) for w in kept}
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * v)
        p = {s: {w: share(cnt[lang, s, w], sum(cnt[lang, s, x] for x in kept)) for w in kept} for s in mine}
        q = {w: share(whole[w], sum(whole.values())) for w in kept}
        for s in mine:
            pairs = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in mine if o != s), key=lambda x: (x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, -x, i + 1) for i, (x, o) in enumerate(pairs)}
            words = sorted(((q[w] - p[s][w], w) for w in kept if cnt[lang, s, w] and p[s][w] > q[w]), key=lambda x: (x[0], x[1].encode()))[:top]
            out |= {(lang, s, "term", w, -x, i + 1) for i, (x, w) in enumerate(words)}
    return out


@pytest.mark.parametrize("seed,sources", [(1, 3), (2, 40)])
def test_divergence_against_brute_force(spark, monkeypatch, seed, sources):
    """Few groups, where most terms are heavy, and many with tiles of 16 groups and light terms in several of them."""
    rng = random.Random(seed)
    words = ["Wort" + "abcdefghijklmnopqrst"[i % 20] + "xyz"[i // 20] for i in range(60)] + ["ÄÖ", "äö", "日本", "dash-ed", "x1y", "\x85  "]
    rows = []
    for i in range(600):
        s = rng.randrange(sources)
        own = words[s % 50 : s % 50 + 12] if rng.random() < 0.8 else words
        text = None if i == 5 else "" if i % 50 == 0 else " ".join(rng.choice(own) for _ in range(rng.randrange(30)))
        rows.append((i, text, rng.choice(["en", "de", None]), None if s == 0 else f"s{s}"))
    rows.append((700, "alone", "xx", "one"))  # no kept term, no other source
    rows += [(701, None, "yy", "a"), (702, "", "yy", "b")]  # pairs without any kept term
    monkeypatch.setattr(divergence, "TILE_GROUPS", 16)
    monkeypatch.setattr(divergence, "TILE_TERMS", 8)
    monkeypatch.setattr(divergence, "HELD", 100)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"term": F.lit("clash"), "g": F.lit(1)}).repartition(6)
    got = [tuple(r) for r in divergence.audit(docs, least_docs=4, terms=5).select("lang", "source", "part", "item", "value", "rank").collect()]
    want = brute_divergence(rows, 4, 5)
    assert len(got) == len(set(got)) and set(got) == want
    if sources == 40:
        groups = Counter(w for w, _ in {(w, (r[2], r[3])) for r in rows for w in (r[1] or "").split()})
        assert min(groups.values()) < 15 < max(groups.values())


def test_divergence_large_counts_and_empty(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    # counts beyond what a billion times them would fit
    one = spark.range(1).select(divergence.share("cast(40000000000000 as bigint)", "cast(90000000000000 as bigint)", "cast(7 as bigint)").alias("p")).first()["p"]
    assert one == 1 + 10**9 * (40000000000000 + 5) // (90000000000000 + 35)


def brute_links(vectors, threshold=0.9):
    """vectors: (id, list or None)."""
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=np.float64)).all() and any(v)]
    n, parent = Counter(), list(range(len(ok)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (i, x)), (b, (j, y)) in itertools.combinations(enumerate(ok), 2):
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            n[a] += 1
            n[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(ok):
        least[root(a)] = min(least.get(root(a), i), i)
    out = sorted((i, n[a], least[root(a)], i == least[root(a)]) for a, (i, _) in enumerate(ok))
    taken = Counter(i for i, _ in ok)
    rest = [(i, 0, i, True) for i, v in vectors if i is not None and not (taken[i] and any(i == k for k, _ in ok))]
    return sorted(out + rest)


def found_links(spark, vectors, **how):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"p": F.lit("clash"), "cell": F.lit(1), "n": F.lit(2)}).repartition(4)
    return sorted(tuple(r) for r in semantic_dedup.dedup(df, **how).select("vec_id", "n_links", "component_id", "kept").collect())


def groups_of_vectors(rng, dim, noise, count, size):
    rows = []
    for _ in range(count):
        centre = rng.standard_normal(dim)
        spread = rng.uniform(0.1, noise)
        rows += [centre + spread * np.linalg.norm(centre) / np.sqrt(dim) * rng.standard_normal(dim) for _ in range(rng.integers(1, size))]
    return rows


@pytest.mark.parametrize("dim,cells,block", [(3, 20, 16), (24, 25, 32), (24, 1, 1024)])
def test_links_against_brute_force(spark, monkeypatch, dim, cells, block):
    """Pairs about the threshold, chains, copies, cells of several blocks, and guests of other cells."""
    monkeypatch.setattr(semantic_dedup, "BLOCK", block)
    rng = np.random.default_rng(dim)
    rows = [v.tolist() for v in groups_of_vectors(rng, dim, 0.45, 60, 12)]
    rows += [rows[0]] * 25 + [rows[3]] * 2  # a hot vector
    order = rng.permutation(len(rows))
    vectors = [(int(i), rows[j]) for i, j in enumerate(order)]
    assert found_links(spark, vectors, cells=cells) == brute_links(vectors)


def test_narrow_margin_is_widened(spark):
    """A margin that loses links is doubled until the sample's are found."""
    rng = np.random.default_rng(5)
    vectors = [(i, v.tolist()) for i, v in enumerate(groups_of_vectors(rng, 8, 0.45, 40, 9))]
    assert found_links(spark, vectors, cells=30, margin=1e-6) == brute_links(vectors)


def test_links_edge_cases(spark):
    assert semantic_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    nan, inf = float("nan"), float("inf")
    vectors = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e200, 1e-200]), (12, [1e-300, 1e-300])]
    got = {r[0]: r[1:] for r in found_links(spark, vectors)}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 12))
    assert [got[i] for i in (7, 8, 9, 11)] == [(3, 7, True), (3, 7, False), (3, 7, False), (3, 7, False)]
    assert found_links(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    # an id that recurs, with equal and with other vectors; no id
    again = found_links(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert [r[1] for r in again] == [0, 1, 1] and {r[2] for r in again} == {1}
    lost = semantic_dedup.dedup(spark.createDataFrame([(None, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, lost), key=str) == [(1, 0, 1, True), (None, 0, None, False)]
