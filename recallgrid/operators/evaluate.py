"""Quality metrics over labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contains_all(text, keywords):
    """Whether a text holds every keyword, whatever the case."""
    return F.forall(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))


def extraction_coverage(extracted: DataFrame, gold: DataFrame, key: str = "fixture") -> DataFrame:
    """Share of gold items that some extracted item covers, and of extracted items that cover none.

    A text's gold items, which are few, make one list; its extracted items meet that once and are counted where they meet it.
    """
    golds = gold.groupBy(key).agg(F.count("*").alias("gold"), F.collect_list(F.struct("gold_idx", "keywords")).alias("golds"))
    items = extracted.select(key, "id", "content", F.lit(1).alias("one"))
    hits = F.transform(F.filter("golds", lambda g: contains_all(F.col("content"), g["keywords"])), lambda g: g["gold_idx"])
    met = golds.join(items, key, "left").select(key, "gold", "id", "one", hits.alias("hits"))
    # an id that recurs counts once as matched; of a text's items only the distinct lists of what they cover are held
    by_id = met.groupBy(key, "id").agg(F.first("gold").alias("gold"), F.count("one").alias("n"), F.collect_set(F.when(F.size("hits") > 0, F.col("hits"))).alias("hits"))
    matched = F.count_if((F.size("hits") > 0) & F.col("id").isNotNull())
    covered = F.size(F.array_compact(F.array_distinct(F.flatten(F.array_distinct(F.flatten(F.collect_set("hits")))))))
    out = by_id.groupBy(key).agg(F.first("gold").alias("gold"), F.sum("n").alias("extracted"), matched.alias("matched"), covered.alias("covered"))
    return out.select(key, "gold", "extracted", F.round(F.col("covered") / F.col("gold"), 4).alias("coverage"), F.round(F.when(F.col("extracted") > 0, (F.col("extracted") - F.col("matched")) / F.col("extracted")).otherwise(0.0), 4).alias("unmatched_ratio"))


def retrieval_scores(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query precision@k, recall@k and reciprocal rank. ranked: query_id, item_id, rank; relevant: query_id, item_id."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    got = ranked.groupBy("query_id").agg(F.count("*").alias("selected"))
    hits = ranked.join(relevant, ["query_id", "item_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    out = n.join(got, "query_id", "left").join(hits, "query_id", "left").fillna(0, ["selected", "hits"])
    shown = F.greatest(F.lit(1), F.least(F.lit(k), F.when(F.col("selected") > 0, F.col("selected")).otherwise(F.lit(k))))
    return out.select("query_id", F.round(F.col("hits") / shown, 4).alias("precision"), F.round(F.col("hits") / F.col("relevant"), 4).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("rr"))


def binary_scores(pairs: DataFrame, predicted, actual) -> DataFrame:
    """True and false positives, misses, precision, recall and F1, with zero guards."""
    c = lambda e: F.count_if(e).alias
    n = pairs.agg(c(predicted & actual)("tp"), c(predicted & ~actual)("fp"), c(~predicted & actual)("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return n.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))


def savings(selected, whole):
    """Share of tokens a selection saves."""
    return F.when(whole > 0, F.round(1 - selected / whole, 4)).otherwise(0.0)


def redaction_recall(samples: DataFrame, findings: str = "found", expected: str = "expected_kinds") -> DataFrame:
    """Recall per planted kind over samples with arrays of found and expected kinds."""
    each = samples.select(F.explode(expected).alias("kind"), F.col(findings).alias("f"))
    return each.groupBy("kind").agg(F.count("*").alias("planted"), F.count_if(F.array_contains("f", F.col("kind"))).alias("found"))
