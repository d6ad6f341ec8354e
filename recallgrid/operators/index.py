"""An inverted index in blocks, and exact BM25 searches over it that never make all pairs of query and item.

A block holds up to BLOCK_ITEMS items. One row says which items they are (their ids, lengths and a weight); one row per term
of the block holds its postings, packed, with two bounds that stay true whatever the corpus' averages are: the highest term
frequency, and the least length per occurrence. Blocks are made where the items lie, without a shuffle.

A search works on blocks, not on pairs:
1. Bounds of (query, block) come from the postings' bounds alone (column pruning leaves the postings unread).
2. The FIRST_BLOCKS blocks of each query with the highest bounds are scored; the k-th best score so far is the query's threshold.
3. Of the other blocks only those whose bound reaches the threshold are scored.
Scoring a block is one task's numpy over its postings and the queries that ask for it, and leaves at most k rows a
query and block. Ties are settled by id, and scores are rounded as the results are, so the pruning loses nothing.

Queries come in batches of at most MOST_TERMS terms, which bounds what is sent to the executors.

A kept index is a folder of segments, each written aside and then made live by one row of `live`; appending writes a segment and changes
no other, and a search sums the statistics (items, tokens, document frequencies) of the live segments, so it equals that
over an index made anew. Postings are partitioned by a hash of their term, so a search reads the buckets of its terms.

Edge cases: items with null or empty text are counted and never found; queries without terms find nothing; terms that no item has
count in a query's ceiling; an id that recurs is several items; an empty index finds nothing.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import B, K1
from ..functions.text import term_text, tokenize
from ..shared import remove, small_batches, written

BLOCK_ITEMS, FIRST_BLOCKS, BUCKETS = 512, 4, 64
#: Terms of the queries that are searched for at a time.
MOST_TERMS = 500_000
BLOCKS = "block string, bucket int, term string, df int, most_tf int, least_ratio double, at binary, tfs binary, lengths binary, weights binary, {ids}"


def build(items: DataFrame, item_id: str = "id", text: str = "content", weight: Column | None = None, asked: set[str] | None = None) -> DataFrame:
    """Blocks of items; with `asked` (at most MOST_TERMS) only these terms are kept. weight: a whole number carried per item."""
    spark = items.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    wanted = None if asked is None else spark.sparkContext.broadcast(asked)
    salt = uuid.uuid4().hex[:8]

    def block(ids: list, weights: list, lengths: array, codes: dict[str, int], code: array, at: array, tf: array, name: str) -> pd.DataFrame:
        lengths = np.array(lengths, dtype="<u4")
        order = np.argsort(np.array(code, dtype=np.int64), kind="stable")
        at, tf = np.array(at, dtype="<u2")[order], np.array(tf, dtype="<u4")[order]
        ends = np.cumsum(np.bincount(np.array(code, dtype=np.int64), minlength=len(codes)))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(codes) else np.empty(0, np.int64)
        packed_at, packed_tf = at.tobytes(), tf.tobytes()
        most = np.maximum.reduceat(tf, starts) if len(codes) else []
        ratio = np.minimum.reduceat(lengths[at] / tf, starts) if len(codes) else []
        rows = {"term": list(codes), "df": ends - starts, "most_tf": most, "least_ratio": ratio, "at": [packed_at[2 * a : 2 * e] for a, e in zip(starts, ends)], "tfs": [packed_tf[4 * a : 4 * e] for a, e in zip(starts, ends)]}
        out = pd.DataFrame(rows)
        head = pd.DataFrame({"term": [None], "df": [len(ids)], "most_tf": [0], "least_ratio": [float(lengths.sum())], "lengths": [lengths.tobytes()], "weights": [np.array(weights, dtype="<i8").tobytes()], "ids": [ids]})
        return pd.concat([out, head], ignore_index=True).assign(block=name)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A text is counted as it comes: a block's postings are held, not its words."""
        keep = None if wanted is None else wanted.value
        task, made = TaskContext.get().partitionId(), 0
        new = lambda: ([], [], array("Q"), {}, array("Q"), array("Q"), array("Q"))
        ids, weights, lengths, codes, code, at, tf = held = new()
        empty = ("at", "tfs", "lengths", "weights", "ids")

        def shaped(f: pd.DataFrame) -> pd.DataFrame:
            for c in empty:
                f[c] = f[c].where(f[c].notna(), None) if c in f else None
            return f.assign(bucket=0)

        for b in batches:
            for i, w, t in zip(b["id"].tolist(), b["weight"].tolist(), b["terms"]):
                words = t.split()
                found = Counter(words if keep is None else [x for x in words if x in keep])
                code.extend(codes.setdefault(x, len(codes)) for x in found)
                at.extend([len(ids)] * len(found))
                tf.extend(found.values())
                ids.append(i)
                weights.append(w)
                lengths.append(len(words))
                if len(ids) == BLOCK_ITEMS:
                    yield shaped(block(*held, f"{salt}-{task}-{made}"))
                    ids, weights, lengths, codes, code, at, tf = held = new()
                    made += 1
        if ids:
            yield shaped(block(*held, f"{salt}-{task}-{made}"))

    shape = BLOCKS.format(ids=f"ids array<{kind}>")
    rows = items.select(F.col(item_id).alias("id"), (F.lit(0) if weight is None else weight).cast("long").alias("weight"), term_text(F.col(text)).alias("terms"))
    return rows.mapInPandas(make, shape).withColumn("bucket", bucket(F.col("term")))


def bucket(term: Column) -> Column:
    return F.when(term.isNull(), F.lit(BUCKETS)).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


@dataclass
class Batch:
    """Some queries with their weights, all in the driver: ids, terms in order, what each term is worth, ceilings."""

    ids: list
    terms: list[list[str]]
    worth: dict[str, float]
    asked_by: dict[str, list[int]]
    ceilings: np.ndarray
    average: float


def batches(queries: DataFrame, query_id: str, query: str) -> Iterator[list[tuple[object, list[str]]]]:
    """Queries with their distinct terms in order, at most MOST_TERMS terms at a time (but one query at least)."""
    held, n = [], 0
    for r in queries.select(F.col(query_id).alias("q"), F.array_distinct(tokenize(F.col(query))).alias("t")).toLocalIterator():
        if held and n + len(r["t"]) > MOST_TERMS:
            yield held
            held, n = [], 0
        held.append((r["q"], list(r["t"])))
        n += len(r["t"])
    if held:
        yield held


def weigh(blocks: DataFrame, asked: list[tuple[object, list[str]]]) -> Batch:
    total = blocks.filter("term is null").agg(F.sum("df").alias("n"), F.sum("least_ratio").alias("tokens")).first()
    n, tokens = total["n"] or 0, total["tokens"] or 0.0
    terms = {t for _, ts in asked for t in ts}
    df = {r["term"]: r["df"] for r in of_terms(blocks, terms).groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the batch's terms at most
    worth = {t: math.log1p((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in terms}
    by: dict[str, list[int]] = {}
    for i, (_, ts) in enumerate(asked):
        for t in ts:
            by.setdefault(t, []).append(i)
    ceilings = np.array([sum(worth[t] * (K1 + 1) for t in ts) for _, ts in asked])
    return Batch([q for q, _ in asked], [ts for _, ts in asked], worth, by, np.where(ceilings > 0, ceilings, 1.0), tokens / n if n else 0.0)


def of_terms(blocks: DataFrame, terms: set[str]) -> DataFrame:
    """Postings of these terms. Buckets are pruned where the blocks are partitioned by them."""
    spark = blocks.sparkSession
    few = spark.createDataFrame([(t,) for t in sorted(terms)], "term string")
    if not terms:
        return blocks.filter("false")
    wanted = [r["b"] for r in few.select(bucket(F.col("term")).alias("b")).distinct().collect()]  # BUCKETS at most
    return blocks.filter(F.col("bucket").isin(wanted)).join(F.broadcast(few), "term")  # MOST_TERMS at most


def bounds(blocks: DataFrame, batch: Batch) -> DataFrame:
    """q (number of the query), block and the highest score that an item of the block can have."""
    spark = blocks.sparkSession
    rows = [(t, w, batch.asked_by[t]) for t, w in batch.worth.items()]
    worth = spark.createDataFrame(rows, "term string, idf double, qs array<int>")
    share = F.col("least_ratio") / batch.average if batch.average > 0 else F.lit(1.0)
    top = F.col("idf") * (K1 + 1) / (1 + F.lit(K1 * (1 - B)) / F.col("most_tf") + F.lit(K1 * B) * share)
    each = blocks.filter("term is not null").select("block", "term", "most_tf", "least_ratio").join(F.broadcast(worth), "term").select("block", F.explode("qs").alias("q"), top.alias("top"))
    ceiling = F.get(F.lit([float(c) for c in batch.ceilings]), F.col("q"))
    return each.groupBy("q", "block").agg(F.sum("top").alias("top")).select("q", "block", F.round(F.least(F.lit(1.0), F.col("top") / ceiling + 1e-9), 4).alias("bound"))


def rounded(x: np.ndarray) -> np.ndarray:
    """Scores to four decimals, halves up by their decimal notation, as the engine's own rounding does."""
    out = np.floor(x * 1e4 + 0.5)
    for i in zip(*np.nonzero(np.abs(x * 1e4 + 0.5 - np.rint(x * 1e4 + 0.5)) < 1e-6)):
        out[i] = int(Decimal(repr(float(x[i]))).quantize(Decimal("0.0001"), ROUND_HALF_UP) * 10_000)
    return out / 1e4


def scores(rows: pd.DataFrame, qs: np.ndarray, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and weights of a block's items, and the raw scores of queries x items."""
    is_head = rows["term"].isna()
    head = rows[is_head].iloc[0]
    ids, lengths, weights = np.array(list(head["ids"])), np.frombuffer(head["lengths"], dtype="<u4"), np.frombuffer(head["weights"], dtype="<i8")
    ratio = lengths / batch.average if batch.average > 0 else np.ones(len(ids))
    place = {int(q): i for i, q in enumerate(qs)}
    s = np.zeros((len(qs), len(ids)))
    mine = rows[~is_head]
    for term, at, tf in zip(mine["term"], mine["at"], mine["tfs"]):
        who = [place[q] for q in batch.asked_by.get(term, ()) if q in place]
        if who:
            at, tf = np.frombuffer(at, dtype="<u2"), np.frombuffer(tf, dtype="<u4").astype(np.float64)
            s[np.ix_(who, at)] += batch.worth[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio[at]))
    return ids, weights, s


Reduce = Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


def score_blocks(blocks: DataFrame, pairs: DataFrame, batch: Batch, reduce: Reduce, schema: str) -> DataFrame:
    """What `reduce` leaves of each (q, block) in pairs: it is given q, ids, weights, raw and rounded scores of the items found.

    Postings of a block meet the queries that ask for it in one task; a block is bounded, and so is a batch of queries."""
    shared = blocks.sparkSession.sparkContext.broadcast((batch.asked_by, batch.worth, batch.ceilings, batch.average))
    asked = of_terms(blocks, set(batch.worth)).select("block", "term", "at", "tfs")
    heads = blocks.filter("term is null").select("block", "term", "lengths", "weights", "ids")
    rows = asked.unionByName(heads, allowMissingColumns=True).join(pairs.select("block").distinct(), "block", "left_semi")

    def score(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        asked_by, worth, ceilings, average = shared.value
        qs = np.sort(wanted["q"].to_numpy(np.int64)) if len(rows) else np.empty(0, np.int64)
        out = []
        for first in range(0, len(qs), 256):
            part = qs[first : first + 256]
            ids, weights, s = scores(rows, part, Batch([], [], worth, asked_by, ceilings, average))
            for i, q in enumerate(part):
                at = np.flatnonzero(s[i] > 0)
                if len(at):
                    raw = np.minimum(1.0, s[i, at] / ceilings[q])
                    out.append(reduce(int(q), ids[at], weights[at], raw, rounded(raw)))
        names = [f.split()[0] for f in schema.split(", ")]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({n: [] for n in names})

    return rows.groupBy("block").cogroup(pairs.select("block", "q").groupBy("block")).applyInPandas(score, schema)


def best_first(ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -score))


def top_reduce(k: int) -> Reduce:
    def reduce(q: int, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
        top = near[best_first(ids[near], score[near])[:k]]
        return pd.DataFrame({"q": q, "item_id": ids[top].tolist(), "lexical": raw[top], "score": score[top]})

    return reduce


def skyband_reduce(k: int, budget: int) -> Reduce:
    """Items within the budget that fewer than k better ones of no greater weight precede: no other can be picked greedily."""

    def reduce(q: int, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        can = np.flatnonzero(weights <= budget)
        least = weights[can].min() if len(can) else 0
        kept, light = [], []
        for i in can[best_first(ids[can], score[can])].tolist():
            if len(light) < k or weights[i] < light[-1]:
                kept.append(i)
                light = sorted([*light, weights[i]])[:k]
                if len(light) == k and light[-1] <= least:
                    break
        return pd.DataFrame({"q": q, "item_id": ids[kept].tolist(), "score": score[kept], "tokens": weights[kept]})

    return reduce


def count_reduce(least: float) -> Reduce:
    def reduce(q: int, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"q": [q], "n": [len(ids)], "kept": [int((score >= least).sum())]})

    return reduce


def before_reduce(last: dict[int, tuple[float, object]]) -> Reduce:
    """How many items stand before and at each query's last one; all where it has none."""

    def reduce(q: int, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        if q not in last:
            return pd.DataFrame({"q": [q], "seen": [len(ids)]})
        s, item = last[q]
        return pd.DataFrame({"q": [q], "seen": [int(((score > s) | ((score == s) & (ids <= item))).sum())]})

    return reduce


def _id_kind(blocks: DataFrame) -> str:
    return blocks.schema["ids"].dataType.elementType.simpleString()


def top_batch(blocks: DataFrame, batch: Batch, k: int) -> DataFrame:
    """q, item_id, lexical, score, rank: the k best items of each query of a batch."""
    spark = blocks.sparkSession
    shape = f"q int, item_id {_id_kind(blocks)}, lexical double, score double"
    limits = written(bounds(blocks, batch), "index-bounds")
    by_bound = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    placed = limits.withColumn("place", F.row_number().over(by_bound))
    first = written(score_blocks(blocks, placed.filter(F.col("place") <= FIRST_BLOCKS), batch, top_reduce(k), shape), "index-first")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "item_id"))
    floors = first.withColumn("rank", rank).filter(F.col("rank") == k).select("q", F.col("score").alias("floor"))
    rest = placed.filter(F.col("place") > FIRST_BLOCKS).join(F.broadcast(floors), "q", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))  # a row a query
    more = score_blocks(blocks, rest, batch, top_reduce(k), shape)
    return first.unionByName(more).withColumn("rank", rank).filter(F.col("rank") <= k)


def named(found: DataFrame, batch: Batch, query_kind: str) -> DataFrame:
    ids = found.sparkSession.createDataFrame([(i, q) for i, q in enumerate(batch.ids)], f"q int, query_id {query_kind}")
    return found.join(F.broadcast(ids), "q").drop("q")  # the batch's queries


def _searched(blocks_for: Callable[[list], DataFrame], queries: DataFrame, query_id: str, query: str, one: Callable[[DataFrame, Batch], DataFrame]) -> DataFrame:
    kind = queries.schema[query_id].dataType.simpleString()
    out = None
    for asked in batches(queries, query_id, query):
        blocks = blocks_for(asked)
        batch = weigh(blocks, asked)
        found = named(one(blocks, batch), batch, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:  # no query at all
        blocks = blocks_for([])
        batch = weigh(blocks, [])
        out = named(one(blocks, batch), batch, kind)
    return out


def top_k(blocks: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, item_id, lexical, score, rank over blocks that are there already."""
    return _searched(lambda _: blocks, queries, query_id, query, lambda b, batch: top_batch(b, batch, k))


def blocks_of(items: DataFrame, item_id: str, text: str, weight: Column | None = None) -> Callable[[list], DataFrame]:
    """Blocks of items for a batch of queries: only its terms are kept."""

    def made(asked: list) -> DataFrame:
        with small_batches(items.sparkSession):
            return written(build(items, item_id, text, weight, {t for _, ts in asked for t in ts}), "index-blocks")

    return made


def search(items: DataFrame, queries: DataFrame, k: int, item_id: str = "id", text: str = "content", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, item_id, lexical, score, rank and matched terms (in the query's order) without an index that is kept."""
    found = _searched(blocks_of(items, item_id, text), queries, query_id, query, lambda b, batch: top_batch(b, batch, k))
    return with_matches(written(found, "index-found"), items, queries, item_id, text, query_id, query)


def with_matches(found: DataFrame, items: DataFrame, queries: DataFrame, item_id: str, text: str, query_id: str, query: str) -> DataFrame:
    """Adds `matched`: of the few items found, which of the query's terms they hold."""
    held = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("_text")).join(found.select("item_id").distinct(), "item_id", "left_semi").dropDuplicates(["item_id"]).select("item_id", tokenize(F.col("_text")).alias("_held"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(tokenize(F.col(query))).alias("_asked"))
    return found.join(held, "item_id").join(asked, "query_id").withColumn("matched", F.array_intersect("_asked", "_held")).drop("_held", "_asked")


def score_counts(items: DataFrame, queries: DataFrame, least: float, item_id: str = "id", text: str = "content", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, n (items that share a term), kept (score at or over `least`), below; a row a query and block is summed up."""

    def one(blocks: DataFrame, batch: Batch) -> DataFrame:
        counts = score_blocks(blocks, written(bounds(blocks, batch), "index-bounds"), batch, count_reduce(least), "q int, n long, kept long")
        return counts.groupBy("q").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).withColumn("below", F.col("n") - F.col("kept"))

    return _searched(blocks_of(items, item_id, text), queries, query_id, query, one)


def budgeted(items: DataFrame, queries: DataFrame, k: int, budget: int, tokens: Column, fold: Callable[[DataFrame], DataFrame], item_id: str = "id", text: str = "content", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, used, picked, dropped: greedy picks under a token budget (see retrieve.budget_state), best score first.

    Only items that can be picked are ranked: of a block those that fewer than k better ones of no greater weight precede. What
    was passed over is counted block by block, and not at all in blocks that can't come before the last pick."""

    def one(blocks: DataFrame, batch: Batch) -> DataFrame:
        limits = written(bounds(blocks, batch), "index-bounds")
        kind = _id_kind(blocks)
        can = written(score_blocks(blocks, limits, batch, skyband_reduce(k, budget), f"q int, item_id {kind}, score double, tokens long"), "index-skyband")
        state = fold(can)
        told = {r["q"]: r for r in state.collect()}  # a row a query of the batch
        last = {q: (r["score"], r["item_id"]) for q, r in told.items() if r["full"]}
        floors = blocks.sparkSession.createDataFrame([(q, s) for q, (s, _) in last.items()], "q int, floor double")
        near = limits.join(F.broadcast(floors), "q", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
        seen = score_blocks(blocks, near, batch, before_reduce(last), "q int, seen long").groupBy("q").agg(F.sum("seen").alias("seen"))
        picks = blocks.sparkSession.createDataFrame([(q, r["used"], r["picked"]) for q, r in told.items()], "q int, used long, picked long")
        out = seen.join(F.broadcast(picks), "q", "left").fillna(0, ["used", "picked"])
        return out.select("q", "used", "picked", (F.col("seen") - F.col("picked")).alias("dropped"))

    return _searched(blocks_of(items, item_id, text, tokens), queries, query_id, query, one)


# An index that is kept


def append(spark: SparkSession, path: str, items: DataFrame, item_id: str = "id", text: str = "content", weight: Column | None = None) -> None:
    """Add items to the index at `path` (made where it isn't there): a segment is written whole, then made live."""
    segment = f"s{uuid.uuid4().hex}"
    blocks = build(items, item_id, text, weight)
    with small_batches(spark):
        blocks.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/segments/segment={segment}")
    spark.createDataFrame([(segment,)], "segment string").coalesce(1).write.mode("append").parquet(f"{path}/live")


def opened(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all live segments."""
    live = sorted(r["segment"] for r in spark.read.parquet(f"{path}/live").distinct().collect())  # a row an append
    return spark.read.parquet(f"{path}/segments").filter(F.col("segment").isin(live)).drop("segment")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write the live segments of an index as one segment of another."""
    segment = f"s{uuid.uuid4().hex}"
    opened(spark, path).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{into}/segments/segment={segment}")
    spark.createDataFrame([(segment,)], "segment string").coalesce(1).write.mode("append").parquet(f"{into}/live")
