"""Source divergence: how sources of a language differ in their words, and which words set a source apart.

A language keeps the terms that enough of its documents hold. A group (language, source) gives each kept term the
smoothed share p of its tokens, in billionths. Two groups differ by the sum of |p - q| over all kept terms.

Heavy-light split: a heavy term is in many of a language's groups. Heavy terms go into dense tiles (terms x groups)
that numpy compares column by column. A light term is in few, and elsewhere has the share z that an absent
term has in that group. For two groups a and b the light terms give
    light * |z_a - z_b|                                                    as if both lacked all of them,
    sum over a's of (|p_a - z_b| - |z_a - z_b|), and likewise over b's,     as if no two lay in both,
    sum over common ones of (|p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|).
The first two need only how often a group has each share; the last one comes from the terms' short posting lists. All
are whole numbers, so partial sums add up exactly in any order.

Counts leave each task summed up by group and term, and are brought together by (language, term), so no language and no source meets in
one task. Terms are raw runs of letters and of all beyond ASCII, A-Z lower-cased.

Edge cases: null text, lang and source are empty strings; a group without terms counts nothing but takes part; a
language without kept terms gives its pairs the value 0 and no terms; a language with one source has no pairs; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_parts, written

#: Documents of its language that a kept term is in, smoothing of counts, unit of shares, terms reported a group.
LEAST_DOCS, SMOOTH, UNIT, TERMS = 30, 5, 1_000_000_000, 50
#: A term in at most LIGHT_GROUPS groups, and at most a LIGHT_SHARE-th of its language's, is light.
LIGHT_GROUPS, LIGHT_SHARE = 64, 8
#: Terms and groups of a dense tile.
TILE_TERMS, TILE_GROUPS = 8192, 256
#: Counts that a task holds before it sends them on.
HELD = 200_000

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TERM_BYTES = bytes(ord(chr(b).lower()) if b < 0x80 and b in _LETTERS else b if b in _LETTERS else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, UTF-8; letters and bytes beyond ASCII make terms, so these are cut alike in bytes."""
    return text.encode().translate(_TERM_BYTES).split()


def group_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, cnt, docs summed up within tasks; a row with a null term for each group a task meets."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[tuple[str, str]] = set()
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> pd.DataFrame:
            rows = [(*g, t.decode(), n, in_docs[t]) for g, (cnt, in_docs) in held.items() for t, n in cnt.items()]
            rows += [(*g, None, 0, 0) for g in held if g not in told]
            told.update(held)
            held.clear()
            return pd.DataFrame(rows, columns=["lang", "source", "term", "cnt", "docs"])

        for b in batches:
            for lang, source, text in zip(b["lang"], b["source"], b["text"]):
                cnt, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                mine = Counter(terms_of(text))
                cnt.update(mine)
                in_docs.update(mine.keys())
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield flush()
        if held:
            yield flush()

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text")).mapInPandas(count, "lang string, source string, term string, cnt long, docs long")


def share(cnt: Column | str, n: str, v: str) -> Column:
    """1 + floor(UNIT * (cnt + SMOOTH) / (n + SMOOTH * v)), in decimals so that no count overflows."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10, 0)) * cast({cnt} + {SMOOTH} as decimal(20, 0))) div cast({n} + {SMOOTH} * {v} as decimal(20, 0))")


def tile_sums(tile: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| between the groups of two blocks (ga <= gb) over a tile's heavy terms."""
    lang, a, b = tile["lang"].iloc[0], int(tile["a"].iloc[0]), int(tile["b"].iloc[0])
    head = tile[tile["term"].isna()].iloc[0]
    tile = tile[tile["term"].notna()]
    term, where = np.unique(tile["term"].to_numpy(), return_inverse=True)
    sides = []
    for block, zs in ((a, head["za"]), (b, head["zb"])):
        m = np.repeat(np.asarray(zs, dtype=np.int64)[:, None], len(term), axis=1)  # a row a group, absent terms at z
        mine = (tile["block"] == block).to_numpy()
        m[tile["g"].to_numpy(np.int64)[mine] - block * TILE_GROUPS, where[mine]] = tile["p"].to_numpy(np.int64)[mine]
        sides.append(m)
    out = []
    for i, row in enumerate(sides[0]):
        first = i + 1 if a == b else 0
        # and terms of the tile that lie in neither block
        s = np.abs(sides[1][first:] - row).sum(axis=1) + (int(head["terms"]) - len(term)) * np.abs(np.asarray(head["zb"], dtype=np.int64)[first:] - int(head["za"][i]))
        out.append(pd.DataFrame({"lang": lang, "ga": a * TILE_GROUPS + i, "gb": b * TILE_GROUPS + np.arange(first, first + len(s)), "value": s}))
    return pd.concat(out, ignore_index=True)


def single_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each group: what it adds to its pairs if no light term of its lay in the other too. zs: z of all groups of the language."""
    for b in batches:
        out = []
        for lang, g, light, zs, ps, ns in zip(b["lang"], b["g"], b["light"], b["zs"], b["ps"], b["ns"]):
            z = np.asarray(zs, dtype=np.int64)
            p, n = np.asarray(ps, dtype=np.int64), np.asarray(ns, dtype=np.int64)
            order = np.argsort(p)
            p, n = p[order], n[order]
            # sum of n * |p - z| by running sums on either side of z
            at = np.searchsorted(p, z)
            upto_n, upto_pn = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(p * n)])
            far = z * upto_n[at] - upto_pn[at] + (upto_pn[-1] - upto_pn[at]) - z * (upto_n[-1] - upto_n[at])
            apart = np.abs(z - z[g])
            value = far - upto_n[-1] * apart
            other = np.arange(len(z))
            value = value + np.where(other > g, int(light) * apart, 0)  # once a pair
            keep = other != g
            out.append(pd.DataFrame({"lang": lang, "ga": np.minimum(other, g)[keep], "gb": np.maximum(other, g)[keep], "value": value[keep]}))
        if out:
            yield pd.concat(out, ignore_index=True)


SUMS = "lang string, ga int, gb int, value long"


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: see above; docs: lang, source, text."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    met = group_terms(docs).repartition(parts, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    met = met.withColumns({"in_docs": F.sum("docs").over(of_term), "lang_cnt": F.sum("cnt").over(of_term), "groups": F.count("*").over(of_term)})
    met = written(met.filter(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).drop("docs", "in_docs"), "divergence-counts")
    kept = met.filter("term is not null")

    # one row a group, and one a language: the sizes of what is compared
    spread = kept.groupBy("lang", "term").agg(F.first("lang_cnt").alias("c"), F.first("groups").alias("groups")).groupBy("lang", "groups").agg(F.count("*").alias("k"), F.sum("c").alias("c"))
    langs = spread.groupBy("lang").agg(F.sum("k").alias("v"), F.sum("c").alias("lang_n"), F.collect_list(F.struct("groups", "k")).alias("spread"))  # an entry a number of groups
    said = kept.groupBy("lang", "source").agg(F.sum("cnt").alias("n"))
    groups = met.filter("term is null").select("lang", "source").distinct().join(said, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    z = F.when(F.col("v") > 0, share("0", "n", "v")).otherwise(F.lit(0))
    g = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")
    groups = groups.select("lang", "source", "n", "v", "lang_n", "spread", z.cast("long").alias("z"), g.alias("g"), F.count("*").over(Window.partitionBy("lang")).alias("s"))
    is_heavy = lambda n: (n > LIGHT_GROUPS) | (n * LIGHT_SHARE > F.col("s"))
    dense = F.aggregate(F.filter("spread", lambda x: is_heavy(x["groups"])), F.lit(0).cast("long"), lambda a, x: a + x["k"])
    groups = written(groups.withColumn("dense", F.coalesce(dense, F.lit(0))).drop("spread"), "divergence-groups")

    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "cnt", "lang_cnt", "groups", "g", "z", "s", "dense", "v", "lang_n", share("cnt", "n", "v").cast("long").alias("p"), is_heavy(F.col("groups")).alias("heavy"))
    shares = written(shares, "divergence-shares")

    # terms that set a group apart
    q = share("lang_cnt", "lang_n", "v")
    apart = shares.withColumn("q", q.cast("long")).filter((F.col("cnt") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = apart.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= terms)

    # pairs: dense tiles, then light terms one by one and in common
    zs = groups.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "z"))), lambda x: x["z"]).alias("zs"))
    block = (F.col("g") / TILE_GROUPS).cast("int")
    blocks = F.ceil(F.col("s") / F.lit(float(TILE_GROUPS))).cast("int")
    count = F.ceil(F.col("dense") / F.lit(float(TILE_TERMS))).cast("int")
    # a row goes to each pair of blocks that its own is one of, and each such tile has a head with the groups' z
    tile = F.pmod(F.xxhash64("term"), count).cast("int")
    rows = shares.filter("heavy").select("lang", tile.alias("tile"), "term", "g", "p", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    none = F.array().cast("array<bigint>")
    # empty, not null: the Arrow writer goes over all nulls at a column's end again with each row
    rows = rows.select("lang", "tile", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "term", "g", "p", "block", none.alias("za"), none.alias("zb"))
    sizes = shares.filter("heavy").select("lang", "s", "term", tile.alias("tile")).distinct().groupBy("lang", "s", "tile").agg(F.count("*").alias("terms"))
    heads = sizes.join(zs, "lang").select("lang", "zs", "tile", "terms", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("a"))
    heads = heads.withColumn("b", F.explode(F.sequence(F.col("a"), F.col("blocks") - 1)))
    cut = lambda side: F.slice("zs", F.col(side) * TILE_GROUPS + 1, TILE_GROUPS)
    dense = rows.unionByName(heads.select("lang", "tile", "a", "b", "terms", cut("a").alias("za"), cut("b").alias("zb")), allowMissingColumns=True)
    from_tiles = dense.groupBy("lang", "tile", "a", "b").applyInPandas(tile_sums, SUMS)

    have = shares.filter("not heavy").groupBy("lang", "g", "p").agg(F.count("*").alias("k")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "k")).alias("l"))
    each = groups.withColumn("light", F.col("v") - F.col("dense")).join(zs, "lang").join(have, ["lang", "g"], "left")
    each = each.select("lang", "g", "light", "zs", F.coalesce(F.col("l.p"), none).alias("ps"), F.coalesce(F.col("l.k"), none).alias("ns"))
    singles = each.mapInPandas(single_sums, SUMS)

    lists = shares.filter("not heavy and groups > 1").groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("g", "p", "z"))).alias("l"))  # LIGHT_GROUPS at most
    both = lists.select("lang", "l", F.posexplode("l").alias("i", "x")).select("lang", "x", F.explode(F.expr("slice(l, i + 2, size(l))")).alias("y"))
    common = F.expr("abs(x.p - y.p) - abs(x.p - y.z) - abs(x.z - y.p) + abs(x.z - y.z)")
    corrections = both.select("lang", F.col("x.g").alias("ga"), F.col("y.g").alias("gb"), common.alias("value"))

    sums = singles.unionByName(from_tiles).unionByName(corrections).groupBy("lang", "ga", "gb").agg(F.sum("value").alias("value"))
    sides = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("ga").alias("g"), F.col("gb").alias("h")), F.struct(F.col("gb").alias("g"), F.col("ga").alias("h")))).alias("x")).select("lang", "value", "x.*")
    named = sides.join(groups.select("lang", "g", "source"), ["lang", "g"]).join(groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(top)
