"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from recallgrid.llm import cdc, chat, curves, langid, mixing, ngram_join, packing, queries, toxicity, url_trust, warc

TOK = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("part", F.lit(1)).withColumn("key", F.lit("x")).withColumn("label", F.lit(2)) if extra else df


EDGE_TEXTS = [None, "", "  \n ", "a", "one two three", "one two three", "x" * 30_000, "word " * 3000, "é ñ ß — 你好", "<|endoftext|> </s>"]


# 1 packing


def test_pack_edge_cases_and_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOK)
    docs = docs_of(spark, EDGE_TEXTS, extra=True)
    docs = docs.unionByName(docs.filter("doc_id = 4"))  # a repeated row
    out = packing.pack(docs, TOK).collect()
    whole = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(EDGE_TEXTS)}
    assert sum(r["length"] for r in out) == sum(map(len, whole.values())) + len(whole[4])
    for r in out:
        ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert r["start"] == 2048 * r["piece"]
    check_packing(out)


def check_packing(out):
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    return len(by)


def test_pack_many_partitions_is_near_the_bound(spark):
    rng = random.Random(3)
    sizes = [min(2048, max(1, int(rng.expovariate(1 / 500)))) for _ in range(6000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], packing.PIECE_SCHEMA)
    out = packing.pack_pieces(pieces, part_pieces=700)
    used = check_packing(out.collect())
    bound = packing.lower_bound(np.array(sizes), 2048)
    assert out.count() == len(sizes) and bound <= used <= bound + max(2, 0.002 * bound)


def test_lower_bound_is_sound_and_beats_the_sum():
    assert packing.lower_bound(np.array([1100] * 7), 2048) == 7
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(1, 2049, size=rng.integers(1, 40))
        bins = packing.best_fit_decreasing(np.sort(x)[::-1], 2048)[2]
        assert -(-int(x.sum()) // 2048) <= packing.lower_bound(x, 2048) <= bins


def test_pack_empty(spark):
    assert packing.pack(docs_of(spark, []), TOK).count() == 0


def test_pack_whole_table(spark, sf):
    out = queries.op1_pack(spark, sf)
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    cert = packing.certificate(out)
    assert cert["bound"] <= cert["sequences"] <= cert["bound"] + 1


# 2 url filter


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/1", "https://x.example.com/en/7/z?q#f", "http://example.net/de/81", "http://notexample.net/de/8", "http://net/de/", "a://b.org/es/9", "ftp://c.org?x=/es/", "http://com/en/"]
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, url_rule string")
    got = {r["page_id"]: (r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) for r in url_trust.judge(pages, threshold=9.0).collect()}
    assert got[0] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/1", "com/en/", "block")
    assert got[4] == ("x.example.com", "/en/7/z", "example.com/en/7", "allow")
    assert got[5] == ("example.net", "/de/81", "example.net/de/8", "allow")
    assert got[6] == ("notexample.net", "/de/8", "net/de/", "block")
    assert got[7][2:] == ("net/de/", "block") and got[8][2:] == ("org/es/", "block")
    assert got[9] == ("c.org", "", None, "allow") and got[10][2:] == ("com/en/", "block")


def test_url_propagation_against_dense(spark):
    hosts = ["good.a", "near.a", "bad.com", "links.b", "far.b", "lone.c"]
    links = {"good.a": ["near.a"], "near.a": ["far.b"], "links.b": ["bad.com", "bad.com", "far.b"], "far.b": [], "bad.com": ["links.b"], "lone.c": []}
    rows = [(i, f"http://{h}/{'en/' if h == 'bad.com' else 'p'}", "".join(f'<a href="//{t}/x">' for t in links[h])) for i, h in enumerate(hosts)]
    rules = (("block", "com/en/"), ("allow", "good.a/"))
    got = {r["url_host"]: r for r in url_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    n = len(hosts)
    w = np.zeros((n, n))
    for h, ts in links.items():
        for t in ts:
            w[hosts.index(h), hosts.index(t)] += 1
    fwd = w / np.maximum(w.sum(1, keepdims=True), 1)
    back = (w / np.maximum(w.sum(0, keepdims=True), 1)).T
    for name, m, seed in (("host_trust", fwd, [1, 0, 0, 0, 0, 0]), ("host_distrust", back, [0, 0, 1, 0, 0, 0])):
        s = np.array(seed, float)
        x = s.copy()
        for _ in range(url_trust.ROUNDS):
            x = s + url_trust.DAMPING * (x @ m)
        assert np.allclose([got[h][name] for h in hosts], x)
    assert {h for h in hosts if got[h]["url_verdict"] == "block"} == {"bad.com", "links.b"}


def test_url_clash_long_and_repeated(spark):
    long = "http://a.com/en/" + "x" * 200_000
    pages = spark.createDataFrame([(1, long, None, "mine"), (1, long, None, "mine"), (2, "http://" + "h" * 100_000, None, "mine")], "page_id long, url string, html string, _r string").withColumn("rule_found", F.lit(7))
    out = url_trust.judge(pages).orderBy("page_id").collect()
    assert [(r["page_id"], r["url_verdict"], r["_r"], r["rule_found"]) for r in out] == [(1, "block", "mine", 7)] * 2 + [(2, "allow", "mine", 7)]
    assert len(out[0]["url_path"]) == 200_004 and len(out[2]["url_host"]) == 100_000


def test_url_empty(spark):
    assert url_trust.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 3 mixing


def brute_mix(rows, max_repeat):
    """rows: doc_id, source, tokens -> alpha and plays per source by the closed form of the covering budget."""
    t = defaultdict(int)
    for _, s, n in rows:
        t[s] += n
    lo, hi = min(t.values()), max(t.values())
    alpha = max(0.0, 1 - np.log(max_repeat) / np.log(hi / lo)) if hi > lo else 0.0
    alpha = np.ceil(round(alpha * 1e6, 3)) / 1e6
    return {s: max(n, int(hi ** (1 - alpha) * n**alpha + 1e-3)) / n for s, n in t.items()}


def test_mix_repeats_and_loses_nothing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), "w " * rng.randint(1, 40)) for i in range(900)] + [(901, "d", None), (902, "d", "")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, src int")
    out = mixing.mix(docs, max_repeat=3.0, block_docs=16).collect()
    want = brute_mix([(i, s, max(1, len((t or "").split()))) for i, s, t in rows], 3.0)
    tokens = defaultdict(int)
    for r in out:
        tokens[r["source"]] += max(1, len((r["text"] or "").split()))
    own = defaultdict(int)
    for _, s, t in rows:
        own[s] += max(1, len((t or "").split()))
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    for s in own:  # the budget is passed by less than a document
        assert -1e-6 <= tokens[s] - want[s] * own[s] + 1 <= 42, s
    plays = defaultdict(lambda: defaultdict(int))
    for r in out:
        plays[r["source"]][r["doc_id"]] += 1
    assert all(max(p.values()) - min(p.values()) <= 1 for p in plays.values())


def test_mix_entropy_and_budget(spark):
    docs = spark.createDataFrame([(i, "a" if i < 90 else "b", "x") for i in range(100)], "doc_id long, source string, text string")
    out = mixing.mix(docs, max_repeat=None, target_entropy=0.5, budget_tokens=50, block_docs=8).collect()
    p = len([r for r in out if r["source"] == "b"]) / len(out)
    assert abs(len(out) - 50) <= 2 and abs(-(p * np.log(p) + (1 - p) * np.log(1 - p)) - 0.5) < 0.05


def test_mix_ties_and_clash(spark):
    rows = [(i % 5, "a" if i < 30 else "b", "one two") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("mix_epoch", F.lit("mine")).withColumn("_src", F.lit(1))
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "text", "_src", "mix_epoch", "mix_block", "mix_order", "mix_weight"]
    assert out.filter("mix_epoch = 0").count() == 40 and out.schema["mix_epoch"].dataType.simpleString() == "int"


def test_mix_empty_and_columns(spark):
    empty = mixing.mix(docs_of(spark, []))
    assert empty.count() == 0
    assert mixing.mix(docs_of(spark, EDGE_TEXTS, extra=True)).columns[:8] == ["doc_id", "text", "lang", "source", "n_chars", "part", "key", "label"]


# 4 fingerprints


def brute_edit(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out[d] = t[: len(t) - k] + nxt[:k]
    return out


def test_cdc_chain_and_likeness(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(EDGE_TEXTS)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, b string")
    for part_rows in (7, 10**6):
        got = {r["doc_id"]: r for r in cdc.compare_edited(df, part_rows).collect()}
        want = brute_edit(rows)
        assert len(got) == len(rows)
        for d, t in rows:
            r = got[d]
            assert r["n_chars"] == len(t or "") and r["edited_sha256"] == hashlib.sha256(want[d].encode()).hexdigest()
            assert r["fingerprint"] == cdc.pack_fingerprint(cdc.chunk_set(t)) and 0 <= r["near_next"] <= 1
    long = [r for r in got.values() if r["n_chars"] > 600 and r["doc_id"] < 10_000]
    assert np.mean([r["near_edited"] for r in long]) > 0.55


def test_cdc_boundaries_shift_and_stretch(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    a, b = cdc.chunk_set(text), cdc.chunk_set("inserted " + text)
    assert cdc.containment(a, b) > 0.95 and cdc.likeness(a, a) == 1.0
    data = text.encode()
    whole = cdc.boundaries(data)
    monkeypatch.setattr(cdc, "STRETCH", 100)
    assert cdc.boundaries(data) == whole and whole[-1] == len(data)
    slow = [sum(int(cdc.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) % 2**32 for i in range(200)]
    assert slow == cdc.gear_hash(np.frombuffer(data[:200], dtype=np.uint8)).tolist()
    assert cdc.unpack_fingerprint(cdc.pack_fingerprint(a)) == a


def test_cdc_single_empty_ties(spark):
    one = cdc.compare_edited(docs_of(spark, ["abcdef"])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one[0]["near_next"] == 1.0
    assert cdc.compare_edited(docs_of(spark, [])).count() == 0
    tied = spark.createDataFrame([(1, "aaa"), (1, "aaa"), (2, "bbb"), (None, "ccc")], "doc_id long, text string")
    assert cdc.compare_edited(tied, 1).count() == 4


# 5 n-gram Jaccard join


def brute_links(rows, n=5):
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    index = defaultdict(list)
    for i in ids:
        seen = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                seen[j] += 1
            index[s].append(i)
        for j, o in seen.items():
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, words, k, edits):
    out = []
    for _ in range(k):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_ngram_join_against_brute_force(spark, sf, monkeypatch):
    rng = random.Random(11)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = [t for k in (60, 25, 9) for t in near_copies(rng, [f"v{rng.randrange(500)}" for _ in range(rng.randint(60, 200))], k, 4)]
    passage = [f"p{i}" for i in range(40)]
    texts += [" ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.randint(5, 30))]) for _ in range(50)]
    chain = [f"c{i}" for i in range(100)]  # each link overlaps the next, the ends do not
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 40, 4)]
    rows += [(10_000 + i, t) for i, t in enumerate(texts + EDGE_TEXTS)]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df).collect()}
    assert got == brute_links(rows)


def test_ngram_join_frequent_list_across_components(spark, monkeypatch):
    """Many near copies whose star and chain alone leave links out."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, t) for i, t in enumerate(t for _ in range(6) for t in near_copies(rng, base, 20, 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df).collect()}
    assert got == brute_links(rows)


def test_components_in_rounds_and_in_one_task(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}
    for a, b in edges:
        x, y = ngram_join.root(parent, a), ngram_join.root(parent, b)
        parent[max(x, y)] = min(x, y)
    want = {x: ngram_join.root(parent, x) for a, b in edges if a != b for x in (a, b)}
    for few in (0, 10**6):
        got = [(r["node"], r["label"]) for r in ngram_join.components(df, few=few).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_keep_one(spark):
    texts = ["a b c d e f g h", "A B C D E F G H", "z y x w v u", None, "", " "]
    docs = docs_of(spark, texts, extra=True)
    docs = docs.unionByName(docs.filter("doc_id = 0")).unionByName(docs.filter("doc_id = 4"))
    kept = ngram_join.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4, 4, 5] and kept.columns == docs.columns
    assert ngram_join.keep_one(docs_of(spark, [])).count() == 0


def test_keep_one_names_the_row_that_stays(spark):
    rows = [(1, "a b c d e f", x) for x in ("z", "k", "m")] + [(2, "a b c d e f", "a")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, _i string").repartition(parts)
        assert [tuple(r) for r in ngram_join.keep_one(df).collect()] == [(1, "a b c d e f", "k")]


def test_ngram_long_lists_in_parts(spark, monkeypatch):
    """A passage in more sets than a row of a list holds, in several groups of near copies."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(120)]
    texts = [" ".join(passage + [f"g{g}w{i}" for i in range(25)] + [f"u{rng.randrange(10**7)}" for _ in range(3)]) for g in range(12) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df).collect()}
    assert got == brute_links(list(enumerate(texts)))


def test_ngram_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for n, m, common in ((0, 1, 0), (1, 1, 1), (5, 40, 3), (300, 310, 250), (300, 1300, 290), (5000, 4000, 3900), (60000, 50000, 45000)):
        pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        a, b = pool[:n], pool[n - common : n - common + m]
        apart = len(np.setxor1d(a, b))
        x, y = ngram_join.parity(a), ngram_join.parity(b)
        assert ngram_join.least_difference(x, y) == ngram_join.least_difference(y, x) <= apart
        assert ngram_join.least_difference(x, x) == 0 and len(x) <= 2**ngram_join.PARITY_BITS // 8
    far = [ngram_join.parity(np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))) for _ in range(2)]
    assert ngram_join.least_difference(*far) > 600 - 2 * ngram_join.needed(300, 300)  # unrelated sets do not pass


def test_ngram_repeated_and_null_ids(spark):
    t = "one two three four five six"
    df = spark.createDataFrame([(1, t), (1, t), (1, "other words here"), (None, t), (5, t)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in ngram_join.link(df).collect())
    assert len(got) == 5 and [g for g in got if g[0] == 5] == [(5, 2, None)]


# 6 chat


def fmt(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ms string")
    return chat.format_chats(df.select("conv_id", "turn", "role", "ms", chat.text_part(F.col("text")).alias("parts")))


def test_chat_round_trip(spark):
    nasty = ["", None, "</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "\\<|text|>\\", "<\\\\|turn|>", "[\\INST]", "<<SYS>> x <</SYS>>", "a\nb", "[[INST]", "<</s>", "\\", "$1 \\1", "你好 <|turn|>", "<|turn|>user<|text|>x<|end|>"]
    rng = random.Random(4)
    nasty += ["".join(rng.choice(["<", "|", "\\", "/s>", "[", "INST]", "end", "text", "é"]) for _ in range(12)) for _ in range(60)]
    rows = [(c, t, rng.choice(["user", "assistant", None, "<|end|>"]), nasty[(c * 7 + t) % len(nasty)], "z") for c in range(30) for t in range(6)] + [(None, 0, "user", "x", "z"), (99, 1, "assistant", "same", "z"), (99, 1, "assistant", "same", "z")]
    got = {r["conv_id"]: r for r in chat.digest(fmt(spark, rows)).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t, r or "", x or ""))
    assert len(got) == len(by)
    for c, ts in by.items():
        if c not in (99, None) and len({t for t, *_ in ts}) != len(ts):
            continue
        ts.sort(key=lambda x: x[0])
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts(spark):
    part = lambda **k: tuple(k.get(x) for x in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    rows = [(1, 0, "user", [part(type="text", text="see "), part(type="image", ref="i.png", width=600, height=500), part(type="audio", ref="a.wav", seconds=2.0), part(type="text", text="<|image:1|>"), part(type="document", ref="d.pdf", pages=3)]), (1, 1, "assistant", None), (2, 0, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert got[1]["formatted"] == "<|turn|>user<|text|>see <|image:1|><|audio:2|><\\|image:1|><|document:4|><|end|><|turn|>assistant<|text|><|end|>"
    assert [(a["type"], a["ref"], a["part"], a["tokens"]) for a in got[1]["attachments"]] == [("image", "i.png", 1, 512), ("audio", "a.wav", 2, 50), ("document", "d.pdf", 4, 1920)]
    assert got[2]["attachments"] == []


def test_chat_query_has_the_probe(spark, sf):
    got = {r["conv_id"]: r for r in queries.op6_chat(spark, sf).collect()}
    t = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest() and got[-1]["loss_chars"] == len(t)


# 7 WARC


def brute_warc(rows):
    top = {}
    for p, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000:
            top[h] = max(top.get(h, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        keep = len(b) < 1000 or top[b] == p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if keep else "revisit", None if keep else top[b]))
    return sorted(out)


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}\r\nX: y", t) for i, t in enumerate([None, "", "short", "short", "L" * 1500, "L" * 1500, "é" * 700, "é" * 700, "WARC/1.1\r\n" * 200, "\x1f\x8b\x08" * 400])] + [(5, "http://again", "L" * 1500)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    assert sorted(tuple(r) for r in warc.round_trip(df).collect()) == brute_warc(rows)


def test_warc_salvage():
    digest = lambda b: hashlib.sha1(b).hexdigest()
    recs = [warc.record("response", f"http://x/{i}", i, digest(b"p%d" % i * 50), len(b"p%d" % i * 50), None, b"p%d" % i * 50) for i in range(6)]
    ms = [warc.member(r) for r in recs]
    whole = b"".join(ms)
    ends = np.cumsum([len(m) for m in ms]).tolist()
    assert [r[0] for k, r in warc.salvage(whole) if k == "record"] == list(range(6))
    hurt = bytearray(whole)
    hurt[ends[1] + len(ms[2]) // 2] ^= 0xFF
    found = list(warc.salvage(bytes(hurt)))
    assert [r[0] for k, r in found if k == "record"] == [0, 1, 3, 4, 5]
    assert [r[:2] for k, r in found if k == "gap"] == [(ends[1], ends[2])]
    cut = whole[: ends[3] - 5] + b"noise" + b"".join(ms[4:])  # only the trailer is lost: the digest proves the record
    assert [r[0] for k, r in warc.salvage(cut) if k == "record"] == [0, 1, 2, 3, 4, 5]
    cut = whole[: ends[3] - 40] + b"noise" + b"".join(ms[4:])
    found = list(warc.salvage(cut))
    assert [r[0] for k, r in found if k == "record"] == [0, 1, 2, 4, 5]
    assert [r[:2] for k, r in found if k == "gap"] == [(ends[2], ends[3] - 35)]
    plain = b"junk" + recs[0] + recs[1][:-30] + recs[2] + ms[3]
    found = list(warc.salvage(plain))
    assert [r[0] for k, r in found if k == "record"] == [0, 2, 3] and [r[:2] for k, r in found if k == "gap"][0] == (0, 4)
    assert list(warc.salvage(b"")) == []


def test_warc_salvage_inside_a_member():
    digest = lambda b: hashlib.sha1(b).hexdigest()
    rng = random.Random(3)
    body = [bytes(rng.randrange(256) for _ in range(400)) + b"%d" % i for i in range(6)]
    recs = [warc.record("response", f"http://x/{i}", i, digest(b), len(b), None, b) for i, b in enumerate(body)]
    whole = warc.member(b"".join(recs))
    ids = lambda data: [r[0] for k, r in warc.salvage(data) if k == "record"]
    gaps = lambda data: [r for k, r in warc.salvage(data) if k == "gap"]
    assert ids(whole) == list(range(6)) and not gaps(whole)
    assert ids(whole[:-10]) == [0, 1, 2, 3, 4, 5][: len(ids(whole[:-10]))] and len(ids(whole[:-10])) >= 5
    assert [g[:2] for g in gaps(whole[:-10])] == [(0, len(whole) - 10)]
    assert ids(whole[: len(whole) // 2] + whole) == [0, 1, 2][: len(ids(whole[: len(whole) // 2]))] + list(range(6))
    wrong = [warc.record("response", f"http://x/{i}", i, digest(b"other") if i == 2 else digest(b), len(b), None, b) for i, b in enumerate(body)]
    bad = warc.member(b"".join(wrong))
    assert ids(bad) == [0, 1, 3, 4, 5] and gaps(bad) == [(0, len(bad), "payload digest fails")]
    # a revisit has no payload to prove it: in a member that fails its checks it is not taken
    again = warc.member(recs[0] + warc.record("revisit", "http://x/9", 9, digest(body[0]), len(body[0]), 0, b""))
    assert ids(again) == [0, 9] and ids(again[:-4] + b"abcd") == [0]


def test_warc_records_of_others():
    import base64

    payload = b"<p>hello</p>"
    said = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.0 200 OK\r\n\r\n" + payload
    made = lambda extra, b: b"WARC/1.0\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n"
    info = made(b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\n", b"software: x\r\n")
    page = made(b"WARC-Type: response\r\nWARC-Target-URI: http://a/\r\nContent-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha1:" + said.encode() + b"\r\n", block)
    again = made(b"WARC-Type: revisit\r\nWARC-Payload-Digest: sha1:" + said.encode() + b"\r\n", b"")
    for data in (info + page + again, warc.member(info) + warc.member(page) + again):
        found = list(warc.salvage(data))
        assert [k for k, _ in found] == ["record"] * 3
        assert [(r[1], r[3]) for _, r in found] == [(13, "warcinfo"), (len(payload), "response"), (None, "revisit")]
        assert found[1][1][2] == found[2][1][2] == hashlib.sha1(payload).hexdigest() and found[1][1][6] == "http://a/"


def test_warc_repeated_task_and_gaps(spark, tmp_path):
    rows = [(i, "http://h", "x" * i) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write_archives(pages, f"file://{tmp_path}", file_bytes=200)
    names = [r["file"].removeprefix("file://") for r in files.collect()]
    # what another attempt of a task left in the folder is nobody's
    (tmp_path / "part-lost-00000.warc.gz").write_bytes(open(names[0], "rb").read()[:50])
    assert sorted(r["page_id"] for r in warc.read_files(files).collect()) == list(range(20)) and len(names) > 3
    found = warc.read_archives(spark, f"file://{tmp_path}").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in found} == {"record": 20, "gap": 1}
    with open(names[0], "r+b") as f:
        f.write(b"\0\0")
    with pytest.raises(Exception, match="records were written"):
        warc.read_files(files).collect()


def test_warc_empty_tasks(spark):
    pages = spark.createDataFrame([(7, "http://h", "html")], "page_id long, url string, html string").repartition(8)
    got = warc.round_trip(pages).collect()
    assert [(r["page_id"], r["payload_bytes"], r["record_type"]) for r in got] == [(7, 4, "response")]


def test_warc_hot_payload(spark):
    rows = [(i, "http://h", "H" * 1200 if i % 3 else "u%d" % i * 600) for i in range(3000)] + [(None, "http://n", "H" * 1200)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and sum(r["record_type"] == "revisit" for r in got) == 2000
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {2999} and sum(r["page_id"] is None for r in got) == 1


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 8 toxicity and 10 language


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, d)
    both = got.join(spark.read.parquet(f"{d}/labels.parquet").filter("toxic is not null"), "doc_id").filter("held_out").collect()
    s, y = np.array([r["score"] for r in both]), np.array([r["toxic"] for r in both])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.9 and np.mean((s >= 0.5) == y) > 0.93
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_toxicity_edge_cases(spark):
    docs = docs_of(spark, EDGE_TEXTS, extra=True)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score_toxicity(docs, model)
    assert [r["toxicity"] for r in out.collect()] == [0.0] * len(EDGE_TEXTS) and out.columns[:-1] == docs.columns
    for words, said in (("vile scum", "you scum and vile"), ("worthless disgusting", "you disgusting and worthless one")):
        rows = [(f"{words} words here number {i}", 1) for i in range(90)] + [(f"plain good words here number {i}", 0) for i in range(90)]
        model = toxicity.train(rows).open()
        assert model.score(said) > 0.5 > model.score("good words") and model.score(None) < 0.5 and model.score("") < 0.5


def test_toxicity_against_brute_force(spark, sf):
    """Every text's score from its definition: one compression of each window with either dictionary, one formula."""
    import math

    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.filter("doc_id < 3")).withColumn("score", F.lit("clash"))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def brute(text):
        words = re.split(rb"[ .,;:!?\"'()\[\]{}|*#$%&\t\n\r\x0b\x0c]+", (text or "").lower().encode())
        words = [w for w in words if w]
        leads = []
        for i in range(0, len(words), 6):
            w = b" " + b" ".join(words[i : i + 6]) + toxicity.TAIL
            size = {}
            for d in (model.ordinary, model.toxic):
                params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, dict_size=len(d), min_match=toxicity.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
                size[d] = len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(w))
            leads.append(size[model.ordinary] - size[model.toxic])
        over = sum(x >= model.threshold for x in leads)
        f = [1, min(max(max(leads), 0), 40) / 8, math.log(1 + over), over / len(leads)] if leads else [1, 0, 0, 0]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, f))))

    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() == {"doc_id", "text", "score", "toxicity"}
    assert np.allclose([r["toxicity"] for r in got], [brute(r["text"]) for r in got], atol=1e-9)


def test_toxicity_labels(spark):
    texts = [f"plain words {i} {'nastything horridly' if i % 2 else 'good'}" for i in range(200)]
    docs = docs_of(spark, texts)
    rows = [(i, i % 2) for i in range(200)]
    once = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    noisy = [*rows, *rows, *[(i, None) for i in range(200)], *[(i, 0) for i in range(1, 200, 2)], (9999, 1), (None, 1)]
    again = toxicity.fit(docs, spark.createDataFrame(noisy, "doc_id long, toxic int"))
    assert (once.toxic, once.ordinary, once.threshold, once.weights) == (again.toxic, again.ordinary, again.threshold, again.weights) and once.toxic
    out = toxicity.score_toxicity(docs_of(spark, [], extra=True), once)
    assert out.count() == 0 and "toxicity" in out.columns
    assert toxicity.fit(docs_of(spark, []), spark.createDataFrame(rows, "doc_id long, toxic int")).score("x") == 0.0


def test_language_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op10_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_language_against_brute_force(spark, sf):
    """Sets and counters of n-grams in plain Python, the same filter bit by bit, every text's prediction."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3))
    model = langid.fit(docs)
    learn = [(r["text"], r["lang"]) for r in docs.collect() if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]

    def grams(text):
        low = "".join(c if c.isalpha() else "\0" for c in text.lower())
        b = re.sub("\0+", " ", low).encode()
        return [int.from_bytes(b[i : i + 5], "big") for i in range(len(b) - 4)]

    def places(g):
        return [((g * m) % 2**64) >> (64 - langid.FILTER_BITS) for m in langid.MULTIPLIERS]

    langs = sorted({x for _, x in learn})
    docs_in = {x: sum(y == x for _, y in learn) for x in langs}
    count = {x: defaultdict(int) for x in langs}
    for t, x in learn:
        for g in set(grams(t)):
            count[x][g] += 1
    rate = {x: {g: c / docs_in[x] for g, c in count[x].items() if c >= min(2, docs_in[x])} for x in langs}
    best = defaultdict(float)
    for x in langs:
        for g, r in rate[x].items():
            best[g] = max(best[g], r)
    bits = {x: {p for g, r in rate[x].items() if r >= langid.LEAST_SHARE * best[g] for p in places(g)} for x in langs}

    def brute(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        gs = grams(text)
        common = min(langs, key=lambda x: (-docs_in[x], x))
        if not gs:
            return common, 0.0
        share = []
        for x in langs:
            chance = (len(bits[x]) / 2**langid.FILTER_BITS) ** 2
            hit = sum(all(p in bits[x] for p in places(g)) for g in gs) / len(gs)
            share.append(min(1, max(0, (hit - chance) / (1 - chance))))
        if max(share) <= 0:
            return common, 0.0
        i = share.index(max(share))
        return langs[i], share[i] / sum(share)

    got = langid.identify(docs.select("doc_id", "text", F.lit(1).alias("_made"), F.lit("x").alias("_p")), model).collect()
    want = [brute(r["text"]) for r in got]
    assert len(got) == 203 and [r["lang_pred"] for r in got] == [w[0] for w in want] and got[0]["_p"] == "x"
    assert np.allclose([r["lang_score"] for r in got], [w[1] for w in want])
    for r in got[:20]:  # a long text in stretches is the same text
        assert model.predict(r["text"], 7) == model.predict(r["text"])


def test_language_many_and_rare(spark):
    """A language with one row among two thousand languages is learned."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) * 2 for k in range(3))
    rows = [(i, f"{word(i)} {word(i)} {word(i)}", f"l{i:04d}", "s", 9) for i in range(1100)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(model.langs) == len(learned) > 800
    assert [model.predict(t)[0] for _, t, *_ in learned[-40:]] == [x for *_, x, _, _ in learned[-40:]]


def test_language_edge_cases(spark):
    docs = docs_of(spark, EDGE_TEXTS + ["12 34", "!!"], extra=True)
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(docs, model).collect()}
    assert [i for i, (p, _) in got.items() if p == "und"] == [0, 1, 2, 10, 11] and all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs_of(spark, []))).collect()} == {"und"}
    assert langid.identify(docs_of(spark, []), model).count() == 0
    tied = langid.train([("same words here", "b"), ("same words here", "a")])
    assert tied.predict("same words here")[:2] == ("a", 0.5)
    assert model.predict("漢字仮名交じり文の文章です") == (model.langs[model.common], 0.0, 0.0)
    many = langid.train([(f"{chr(97 + i // 26) * 3}{chr(97 + i % 26) * 3} " * 9, f"l{i:03d}") for i in range(70)])
    assert many.predict("cccrrr cccrrr")[0] == f"l{2 * 26 + 17:03d}" and len(many.words) == 2


# 9 neighbours


def brute_nearest(rows, k=5, every=50):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = curves.cosines(q, m)
            best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def test_neighbours_exact(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((700, 12)).astype(np.float32)
    base[300:420] = base[300]  # a vector that recurs
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(800, None), (850, [0.0] * 12), (900, [float("nan")] * 12), (950, []), (1000, [1.0, None] + [0.0] * 10), (1050, [float("inf")] * 12)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, key int").repartition(5)
    got = defaultdict(list)
    for r in curves.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def found_by(df, **how):
    got = defaultdict(list)
    for r in curves.nearest(df, **how).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_neighbours_recall_by_small_windows(spark):
    """Windows of a few rows on clusters, one of them dense and as large as the rest, and on noise without any structure."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 12))
    rows = [(i, (centres[i % 60] + 0.01 * rng.standard_normal(12)).tolist()) for i in range(1200)]
    rows += [(1200 + i, (centres[0] + 0.001 * rng.standard_normal(12)).tolist()) for i in range(1200)]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=32, target=0.97)
    assert recall(got, brute_nearest(rows)) >= 0.9
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=128)
    assert recall(got, brute_nearest(rows)) >= 0.9


def test_neighbours_hard_rows(spark):
    """Ids that recur, lengths that differ, components at the ends of what a double holds, zeros of either sign."""
    rng = np.random.default_rng(4)
    rows = [(i % 140, (v * 10.0 ** rng.integers(-200, 200)).tolist()) for i, v in enumerate(rng.standard_normal((160, 5)))]
    rows += [(500, [1e308, -1e308, 1e308, 0.0, 0.0]), (501, [5e-324, -5e-324, 0.0, 0.0, 0.0]), (550, [0.0, 1.0, 0.0, 0.0, 0.0]), (551, [-0.0, 2.0, -0.0, 0.0, 0.0])]
    rows += [(600 + i, [1.0, float(i)]) for i in range(60)] + [(1000, [3.0] * 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string").repartition(6)
    got = found_by(df)
    for q, found in got.items():
        mine = [np.array(v) for i, v in rows if i == q]
        best = {}
        for i, v in rows:
            if i != q:
                for m in mine:
                    if len(m) == len(v):
                        best.setdefault(i, []).append(float(curves.cosines(m, np.array([v]))[0]))
        assert all(any(abs(s - x) < 1e-9 for x in best[i]) for i, s in found) and all(np.isfinite(s) for _, s in found)
    one = brute_nearest([r for r in rows if len(r[1]) == 2])
    for q, w in one.items():
        assert [v for v, _ in got[q]] == [v for v, _ in w]
    assert got[550][0][0] == 551 and abs(got[550][0][1] - 1) < 1e-12 and 1000 not in got and set(one) == {600, 650}


def test_hilbert_curve_is_continuous():
    p = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    k = curves.hilbert_keys(p, 3)
    assert sorted(k.tolist()) == list(range(512))
    step = np.abs(np.diff(p[np.argsort(k)], axis=0)).sum(axis=1)
    assert (step == 1).all()


def test_neighbours_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in curves.nearest(few).collect()] == [(0, 1, 1)]
    assert curves.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# pipeline


def test_pipeline_language_stage_drops_what_was_never_learned(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang_found", F.lit("clash"))
    odd = spark.createDataFrame([(90001, "漢字仮名交じり文の文章です"), (90002, "12 34"), (90003, None), (90004, "ab")], "doc_id long, text string")
    out = pipeline.known_language(spark, docs.unionByName(odd, allowMissingColumns=True), sf)
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    lettered = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert out.columns == docs.columns and kept == lettered | {90004}


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        seen.append((name, out.count()))
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    assert [n for n, _ in seen] == ["toxicity", "language_id", "ngram_jaccard_join", "mixing", "packing"]
    ids = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    links = brute_links([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["doc_id"] in ids])
    assert all(c == i for i, (_, c) in links.items())
