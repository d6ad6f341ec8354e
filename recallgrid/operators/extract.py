"""Rule-based extraction of memory items from texts, and the parsing of model replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import category_order, clean, item_id, sentences, strip, user_messages


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def rules(s: Column, low: Column | None = None) -> dict[str, Column]:
    """Whether each category's rule fires on a sentence; `low` is the sentence in lower case, where a column has it. Patterns
    only run on sentences that hold one of their leads."""
    low = F.lower(s) if low is None else low
    said = lambda words: _any([low.contains(w) for w in words])
    matches = lambda patterns, leads: _any([said(words) & s.rlike("(?i)" + p) for p, words in zip(patterns, leads, strict=True)])
    return {
        "identity": matches(C.IDENTITY_PATTERNS, C.IDENTITY_LEADS),
        "projects": matches(C.PROJECT_PATTERNS, C.PROJECT_LEADS),
        "facts": said(C.FACT_KEYWORDS),
        "decisions": said(C.DECISION_KEYWORDS),
        "open_tasks": said(C.TASK_KEYWORDS) & ~said(C.DONE_WORDS),
        "preferences": said(C.PREFERENCE_KEYWORDS),
    }


def candidate_sentences(c: Column) -> Column:
    """Users' sentences, or all of them where no user speaks."""
    users = F.flatten(F.transform(user_messages(c), sentences))
    return F.when(F.size(users) > 0, users).otherwise(sentences(c))


def extract(texts: DataFrame, key: str, text: str, origin: Column | None = None) -> DataFrame:
    """Items of each text: key, category, pos, id, content, confidence, source, origin.

    Texts are dealt by key once, before any rule runs, so that work is spread whatever the files are and the
    windows (and joins and groups by key after them) need no further shuffle. One pass explodes sentences (users', or all of them where no user speaks), tags
    each with all categories that fire, and drops repeats per text and category, the first staying.
    Arrays are exploded with `outer` and then filtered: for a plain explode the plan tests the array's size and
    nullness beforehand, which runs all expressions behind it three times.
    """
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = texts.select(F.col(key).alias("key"), (origin if origin is not None else F.lit("")).alias("origin"), F.col(text).alias("_text")).repartition(parts, "key")
    asked = dealt.withColumn("_users", F.flatten(F.transform(user_messages(F.col("_text")), sentences)))
    said = asked.select("key", "origin", F.posexplode_outer(F.when(F.size("_users") > 0, F.col("_users")).otherwise(sentences(F.col("_text")))).alias("spos", "sentence")).filter("sentence is not null")
    lowered = said.withColumn("_low", F.lower("sentence"))
    fired = F.array_compact(F.array(*[F.when(on, F.lit(cat)) for cat, on in rules(F.col("sentence"), F.col("_low")).items()]))
    items = lowered.select("key", "origin", "spos", "sentence", F.explode_outer(fired).alias("category")).filter("category is not null").select("key", "origin", "spos", clean(F.col("sentence")).alias("content"), "category")
    again = Window.partitionBy("key", "category", F.lower(strip(F.col("content")))).orderBy("spos")
    items = items.withColumn("_r", F.row_number().over(again)).filter("_r = 1")
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("category")]
    pos = F.row_number().over(Window.partitionBy("key", "category").orderBy("spos")) - 1
    return items.select("key", "category", pos.alias("pos"), item_id(F.col("category"), F.col("content")).alias("id"), "content", table(C.CONFIDENCE).alias("confidence"), table(C.RULE_TAGS).alias("source"), "origin")


REPLY_SCHEMA = "map<string,variant>"


def parse_replies(replies: DataFrame, key: str, reply: str, origin: str = "") -> DataFrame:
    """Items of model replies: JSON objects of lists, of strings or objects; anything else gives none."""
    body = F.regexp_replace(F.regexp_replace(strip(F.col(reply)), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    v = replies.select(F.col(key).alias("key"), F.try_parse_json(body).alias("v"))
    per = [F.struct(F.lit(c).alias("category"), F.try_variant_get("v", f"$.{c}", "array<variant>").alias("xs")) for c in C.CATEGORIES]
    rows = v.select("key", F.explode(F.array(*per)).alias("p")).select("key", "p.category", F.posexplode("p.xs").alias("pos", "x"))
    is_text = F.schema_of_variant("x") == "STRING"
    content = strip(F.coalesce(F.when(is_text, F.try_variant_get("x", "$", "string")).otherwise(F.try_variant_get("x", "$.content", "string")), F.lit("")))
    sure = F.coalesce(F.try_variant_get("x", "$.confidence", "double"), F.lit(1.0))
    rows = rows.select("key", "category", "pos", content.alias("content"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(is_text, 1.0).otherwise(sure))).alias("confidence"), F.coalesce(F.when(~is_text, F.try_variant_get("x", "$.source", "string")), F.lit("")).alias("source"), F.lit(origin).alias("origin"))
    rows = rows.filter("content <> ''").withColumn("id", item_id(F.col("category"), F.col("content")))
    pos = F.row_number().over(Window.partitionBy("key", "category").orderBy("pos")) - 1
    return rows.withColumn("pos", pos).orderBy("key", category_order(F.col("category")), "pos")
