"""Temperature mixing of sources to target weights, in DataFrame functions only.

Source shares of tokens are raised to an exponent and normalised. The exponent is bisected: the
smallest one (flattest mixture) in [0, 1] whose repetition stays within `max_repeat`, and whose entropy
does not pass `target_entropy` if one is given. The budget is `budget_tokens`, or else the smallest that
plays every source at least once, so that no document is lost. Weights are realised as block
permutations: an epoch of a source plays its blocks in an order drawn for that epoch, and the documents
of a block likewise; a last, partial epoch plays the head of its permutation until the budget is spent.

Only per-source rows (a boundary block and a cut inside it) travel to the documents, never a ranking of
them: whether a document is played in the partial epoch follows from its own keys.

Edge cases: a null source is a source of its own (given back as null); null and empty texts count one
token; repeated rows share their key and are played together; a tie at the budget's end plays the whole
tie; an empty table gives an empty result; columns of the input keep their names and values, but for
those that the result names (mix_epoch, mix_block, mix_order, mix_weight), which it replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

MAX_REPEAT = 1.5
BLOCK_DOCS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Sections that one pass over the sources divides the interval of the exponent into, and passes.
SECTIONS, PASSES = 16, 8
#: The plan (a row per source) is broadcast up to this many sources, joined by shuffle beyond.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mixture:
    alpha: float
    budget: float
    plan: DataFrame  # source key, tokens, weight, budget_tokens, epochs, rest, boundary block key, cut


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))).cast("long")


def _md5(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))


def _source(c: Column) -> Column:
    """A key that keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit("~"))


def _order(key: Column, epoch: Column) -> Column:
    return _md5(key, epoch)


def _section(stats: DataFrame, low: float, high: float, ok) -> float:
    """Smallest exponent in [low, high] that is ok; ok holds from some exponent on."""
    for _ in range(PASSES):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        t = F.col("tokens").cast("double")
        sums = [F.sum(F.pow(t, F.lit(a))).alias(f"z{i}") for i, a in enumerate(grid)] + [F.sum(F.pow(t, F.lit(a)) * F.log(t)).alias(f"e{i}") for i, a in enumerate(grid)]
        row = stats.agg(F.min(t).alias("low"), F.max(t).alias("high"), F.sum(t).alias("all"), *sums).first()
        first = next((i for i in range(SECTIONS + 1) if ok(grid[i], row, row[f"z{i}"], row[f"e{i}"])), SECTIONS)
        if first == 0:
            return low
        low, high = grid[first - 1], grid[first]
    return high


def plan_mixture(slim: DataFrame, max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None, budget_tokens: int | None = None) -> Mixture:
    """slim: src, block, key, tokens of every document."""
    stats = written(slim.groupBy("src").agg(F.sum("tokens").alias("tokens")), "mix-stats")
    if not stats.head(1):
        return Mixture(1.0, 0.0, stats.selectExpr("src", "tokens", "0D weight", "0L budget_tokens", "0 epochs", "0L rest", "'' edge_block", "'' edge_key"))

    def budget(alpha: float, row, z: float) -> float:
        return float(budget_tokens) if budget_tokens else row["high"] ** (1 - alpha) * z

    def ok(alpha: float, row, z: float, e: float) -> bool:
        repeat = budget(alpha, row, z) * row["low"] ** (alpha - 1) / z
        entropy = math.log(z) - alpha * e / z
        return (max_repeat is None or repeat <= max_repeat * (1 + 1e-12)) and (target_entropy is None or entropy <= target_entropy + 1e-12)

    alpha = math.ceil(_section(stats, 0.0, 1.0, ok) * 1e6) / 1e6
    t = F.col("tokens").cast("double")
    row = stats.agg(F.sum(F.pow(t, F.lit(alpha))).alias("z"), F.max(t).alias("high")).first()
    total = budget(alpha, row, row["z"])
    weight = F.pow(t, F.lit(alpha)) / row["z"]
    spent = F.floor(F.round(weight * total, 3)).cast("long")
    if not budget_tokens:
        spent = F.greatest(F.col("tokens"), spent)
    per = stats.select("src", "tokens", weight.alias("weight"), spent.alias("budget_tokens"))
    per = per.select("*", F.floor(F.col("budget_tokens") / F.col("tokens")).cast("int").alias("epochs"), (F.col("budget_tokens") % F.col("tokens")).alias("rest"))

    # the block of the partial epoch in which the budget ends
    blocks = slim.groupBy("src", "block").agg(F.sum("tokens").alias("bt")).join(per.select("src", "epochs", "rest"), "src")
    blocks = blocks.select("*", _order(F.col("block"), F.col("epochs")).alias("bkey"))
    run = Window.partitionBy("src").orderBy("bkey", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = blocks.withColumn("upto", F.sum("bt").over(run)).filter("upto - bt < rest and upto >= rest").select("src", "block", "bkey", "epochs", (F.col("rest") - F.col("upto") + F.col("bt")).alias("left"))
    inside = slim.join(edge, ["src", "block"]).select("src", "bkey", "left", _order(F.col("key"), F.col("epochs")).alias("dkey"), "tokens")
    inside = inside.groupBy("src", "bkey", "left", "dkey").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy("src").orderBy("dkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = inside.withColumn("upto", F.sum("t").over(upto)).filter("upto - t < left").groupBy("src", "bkey").agg(F.max("dkey").alias("edge_key"))
    plan = per.join(cut.withColumnRenamed("bkey", "edge_block"), "src", "left")
    return Mixture(alpha, total, written(plan.fillna("", ["edge_block", "edge_key"]), "mix-plan"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None, budget_tokens: int | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows of `docs` as often as the mixture plays them, with mix_epoch, mix_block, mix_order, mix_weight.

    Sorting a source by (mix_epoch, mix_block, mix_order) gives the order of its stream.
    """
    src, key = _source(F.col(source_col)), _md5("doc", F.col(id_col))
    keyed = docs.select(src.alias("src"), key.alias("key"), token_count(F.col(text_col)).alias("tokens"))
    slim = written(keyed, "mix-slim")
    n = slim.groupBy("src").count().agg(F.max("count").alias("n"), F.count("*").alias("s")).first()
    blocks = max(1, -(-(n["n"] or 0) // block_docs))
    block = lambda k: F.conv(F.substring(k, 1, 8), 16, 10).cast("long") % blocks
    mixture = plan_mixture(slim.withColumn("block", block(F.col("key"))), max_repeat, target_entropy, budget_tokens)
    kept = [c for c in docs.columns if c not in ("mix_epoch", "mix_block", "mix_order", "mix_weight")]
    names = dict(zip(kept, [f"_c{i}" for i in range(len(kept))]))
    own = docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in kept], src.alias("_src"), key.alias("_key"), block(key).alias("_block"))
    plan = mixture.plan.select(F.col("src").alias("_src"), "epochs", "rest", "edge_block", "edge_key", "weight")
    if n["s"] <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    last_block, last_key = _order(F.col("_block"), F.col("epochs")), _order(F.col("_key"), F.col("epochs"))
    in_rest = (F.col("rest") > 0) & ((last_block < F.col("edge_block")) | ((last_block == F.col("edge_block")) & (last_key <= F.col("edge_key"))))
    plays = F.col("epochs") + in_rest.cast("int")
    played = own.join(plan, "_src").withColumn("_plays", plays).filter("_plays > 0")
    played = played.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_plays") - 1)))
    return played.select(
        *[F.col(names[c]).alias(c) for c in kept], "mix_epoch", _order(F.col("_block"), F.col("mix_epoch")).alias("mix_block"), _order(F.col("_key"), F.col("mix_epoch")).alias("mix_order"), F.round("weight", 9).alias("mix_weight")
    )
