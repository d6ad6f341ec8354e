"""Explainable BM25 retrieval, optionally blended with vector similarity, under top-k and token budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import B, K1, NO_QUERY_REASON
from ..functions.text import category_order, estimate_tokens, reason, tokenize
from ..shared import written


@dataclass(frozen=True)
class RetrievalOptions:
    top_k: int = 5
    categories: tuple[str, ...] | None = None
    token_budget: int | None = None
    min_score: float = 0.0

    def __post_init__(self):
        if not 1 <= self.top_k <= 100 or not 0 <= self.min_score <= 1 or (self.token_budget is not None and self.token_budget < 1):
            raise ValueError("top_k is 1 to 100, min_score 0 to 1, token_budget at least 1")


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """query_id, term, qpos: distinct terms of each query in their order."""
    return queries.select(F.col(query_id).alias("query_id"), F.posexplode(F.array_distinct(tokenize(F.col(text)))).alias("qpos", "term"))


def bm25(items: DataFrame, queries: DataFrame, item_id: str = "id", text: str = "content", query_id: str = "query_id", query: str = "query", carry: tuple[str, ...] = ()) -> DataFrame:
    """query_id, item_id, lexical (0 to 1) and matched terms of every pair that shares a term, and the items' columns `carry`.

    Statistics cover all items. Only tokens that some query asks for leave the scan's stage: the terms are
    joined to the exploded tokens first (broadcast when small enough), then counted with map-side combine.
    """
    tokens = items.select(F.col(item_id).alias("item_id"), tokenize(F.col(text)).alias("tokens"), *[F.col(c).alias(f"_{c}") for c in carry])
    kept = [F.first(f"_{c}").alias(f"_{c}") for c in carry]
    stats = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens").cast("double")).alias("avgdl"))
    terms = query_terms(queries, query_id, query)
    asked = terms.select("term").distinct()
    counted = tokens.select("item_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"), *[f"_{c}" for c in carry]).join(asked, "term").groupBy("item_id", "term").agg(F.first("dl").alias("dl"), F.count("*").alias("tf"), *kept)
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term", "left").crossJoin(F.broadcast(stats)).select("query_id", "term", "qpos", "avgdl", F.log1p((F.col("n") - F.coalesce("df", F.lit(0)) + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5)).alias("idf"))
    ceiling = weighted.groupBy("query_id").agg(F.sum(F.col("idf") * (K1 + 1)).alias("ceiling"))
    ratio = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(1.0)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * ratio))
    hits = counted.join(weighted, "term").groupBy("query_id", "item_id").agg(F.sum(part).alias("raw"), F.sort_array(F.collect_list(F.struct("qpos", "term"))).alias("m"), *kept)
    top = F.when(F.col("ceiling") > 0, F.col("ceiling")).otherwise(1.0)
    return hits.join(ceiling, "query_id").select("query_id", "item_id", F.least(F.lit(1.0), F.col("raw") / top).alias("lexical"), F.col("m.term").alias("matched"), *[F.col(f"_{c}").alias(c) for c in carry])


def ranked(scored: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first per query. Ties are settled by `order`."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col(rank) <= k)


def fold_budget(cands: Column, top_k: int, budget: int | None) -> Column:
    """Greedy selection over candidates in order: those that pass the budget are skipped, and it stops at top_k.

    cands: array of struct(key, tokens). Gives struct(used, dropped, full, picked keys).
    """
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("dropped"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("picked"))

    def step(a: Column, c: Column) -> Column:
        full = a["full"] | (F.size(a["picked"]) >= top_k)
        over = F.lit(False) if budget is None else a["used"] + c["tokens"] > budget
        take = ~full & ~over
        return F.struct(
            F.when(take, a["used"] + c["tokens"]).otherwise(a["used"]).alias("used"),
            F.when(~full & over, a["dropped"] + 1).otherwise(a["dropped"]).alias("dropped"),
            full.alias("full"),
            F.when(take, F.array_append(a["picked"], c["key"])).otherwise(a["picked"]).alias("picked"),
        )

    return F.aggregate(cands, zero, step)


def select_in_budget(scored: DataFrame, top_k: int, budget: int) -> DataFrame:
    """query_id, used, picked and dropped of fold_budget over all candidates of each query, best score first, then item_id.

    scored: query_id, item_id, score, tokens. What is left of the budget only shrinks, so of the candidates with equal
    tokens those picked are the first ones, at most top_k: the fold reads no more than these (top_k for each number of
    tokens within the budget). What was dropped before the last pick is counted over all candidates.
    """
    cand = written(scored.select("query_id", "item_id", "score", "tokens"), "candidates")
    same = Window.partitionBy("query_id", "tokens").orderBy(F.desc("score"), "item_id")
    first = cand.filter(F.col("tokens") <= budget).withColumn("r", F.row_number().over(same)).filter(F.col("r") <= top_k)
    lists = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id", "tokens"))).alias("l"))
    fold = lists.withColumn("f", fold_budget(F.transform("l", lambda c, i: F.struct(i.cast("string").alias("key"), c["tokens"].alias("tokens"))), top_k, budget))
    last = F.when(F.size("f.picked") >= top_k, F.get("l", F.element_at("f.picked", -1).cast("int")))
    state = fold.select(F.col("query_id").alias("q"), "f.used", F.size("f.picked").cast("long").alias("picked"), last.alias("last"))
    before = F.col("last").isNull() | (-F.col("score") < F.col("last.s")) | ((-F.col("score") == F.col("last.s")) & (F.col("item_id") <= F.col("last.item_id")))
    seen = cand.join(F.broadcast(state), F.col("query_id") == F.col("q"), "left").groupBy("query_id").agg(F.count_if(before).alias("seen"), *[F.coalesce(F.first(c), F.lit(0).cast("long")).alias(c) for c in ("used", "picked")])
    return seen.select("query_id", "used", "picked", (F.col("seen") - F.col("picked")).alias("dropped"))


def budget_state(cands: DataFrame, top_k: int, budget: int) -> DataFrame:
    """q, used, picked, full, and the last pick (score, item_id) where top_k were picked: fold_budget over each query's candidates, best score first, then item_id.

    cands: q, item_id, score, tokens; a bounded number a query (see index.skyband_reduce), which holds all that can be picked.
    """
    lists = cands.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id", "tokens"))).alias("l"))
    fold = lists.withColumn("f", fold_budget(F.transform("l", lambda c, i: F.struct(i.cast("string").alias("key"), c["tokens"].alias("tokens"))), top_k, budget))
    last = F.get("l", F.coalesce(F.try_element_at("f.picked", F.lit(-1)), F.lit("0")).cast("int"))
    return fold.select("q", "f.used", F.size("f.picked").cast("long").alias("picked"), (F.size("f.picked") >= top_k).alias("full"), last["item_id"].alias("item_id"), (-last["s"]).alias("score"))


def assemble(items: DataFrame, query: str, options: RetrievalOptions = RetrievalOptions(), embeddings: DataFrame | None = None, weight: float = 0.5, transcript_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Selected items with rank, score and reason, and a one-row summary, for one query over a memory.

    items: id, category, content, confidence, source. embeddings: id, cosine (see VectorTable.similarities); of an id
    that recurs the highest counts, so an item is there once.
    A package is bounded (MAX_TEXT_CHARS per import), so the fold over its candidates is one row.
    """
    spark = items.sparkSession
    q = spark.createDataFrame([(0, query)], "query_id int, query string")
    indexed = items.withColumn("_text", F.concat_ws(" ", "content", F.coalesce("source", F.lit(""))))
    scores = bm25(indexed, q, "id", "_text").select(F.col("item_id").alias("id"), "lexical", "matched")
    has_query = q.select(F.size(tokenize(F.col("query"))).alias("n")).first()["n"] > 0
    cand = items.join(scores.dropDuplicates(["id"]), "id", "left").withColumns({"lexical": F.coalesce("lexical", F.lit(0.0)), "matched": F.coalesce("matched", F.array().cast("array<string>"))})
    if options.categories:
        cand = cand.filter(F.col("category").isin(*options.categories))
    if embeddings is not None:
        cand = cand.join(embeddings.groupBy("id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("cosine"))).alias("emb")), "id", "left")
    else:
        cand = cand.withColumn("emb", F.lit(None).cast("double"))
    blend = F.coalesce((1 - weight) * F.col("lexical") + weight * F.col("emb"), F.col("lexical")) if has_query else F.col("confidence")
    why = reason(F.col("matched"), F.col("lexical"), F.col("emb")) if has_query else F.lit(NO_QUERY_REASON)
    cand = cand.withColumns({"score": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend)), 4), "reason": why, "tokens": estimate_tokens(F.col("content"))})
    shown = ("id", "category", "content", "score", "lexical", "emb", "matched", "reason", "tokens")
    order = F.struct((-F.col("score")).alias("s"), (-F.col("confidence")).alias("c"), category_order(F.col("category")).alias("o"), F.col("id").alias("i"), *[F.col(c) for c in shown if c != "id"])
    low = (lambda c: c["score"] < options.min_score) if has_query else (lambda c: F.lit(False))
    evid = (lambda c: (c["score"] > 0) | F.lit(options.min_score > 0)) if has_query else (lambda c: F.lit(True))
    one = cand.agg(F.sort_array(F.collect_list(order)).alias("all"), F.count("*").alias("considered")).withColumn("pass", F.filter("all", lambda c: ~low(c) & evid(c)))
    fold = one.withColumn("f", fold_budget(F.transform("pass", lambda c, i: F.struct(i.cast("string").alias("key"), c["tokens"].alias("tokens"))), options.top_k, options.token_budget))
    fold = fold.withColumn("below", F.when(F.col("f.full"), 0).otherwise(F.size(F.filter("all", low))))
    picked = fold.select(F.posexplode(F.transform("f.picked", lambda k: F.get("pass", k.cast("int")))).alias("p", "x"))
    selected = picked.select((F.col("p") + 1).alias("rank"), F.col("x.i").alias("id"), "x.category", "x.content", "x.score", F.round("x.lexical", 4).alias("lexical_score"), F.round("x.emb", 4).alias("embedding_score"), "x.matched", "x.reason", "x.tokens")
    totals = items.agg(F.count("*").alias("total_items"), F.sum(estimate_tokens(F.col("content"))).alias("tokens_full_memory"))
    summary = fold.select("considered", F.col("below").alias("dropped_below_min_score"), F.col("f.dropped").alias("dropped_for_budget"), F.col("f.used").alias("tokens_selected")).crossJoin(totals)
    saved = F.greatest(F.lit(0), F.coalesce("tokens_full_memory", F.lit(0)) - F.col("tokens_selected"))
    summary = summary.withColumn("tokens_saved_vs_full_memory", saved).withColumn("tokens_saved_vs_transcript", F.greatest(F.lit(0), F.lit(transcript_tokens) - F.col("tokens_selected")) if transcript_tokens is not None else F.lit(None).cast("long"))
    return selected, summary


def cosine(a: Column, b: Column) -> Column:
    d = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(d(a, a)), F.sqrt(d(b, b))
    return d(a, b) / (F.when(na > 0, na).otherwise(1.0) * F.when(nb > 0, nb).otherwise(1.0))


def vector_top_k(vectors: DataFrame, probe: list[float], k: int = 5, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Rows nearest to a probe by cosine; a row of another dimension is an error."""
    p = F.array(*[F.lit(float(x)) for x in probe])
    checked = vectors.filter(F.assert_true(F.size(vec) == len(probe)).isNull())
    return checked.select(key, cosine(F.col(vec), p).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)
