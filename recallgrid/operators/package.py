"""Versioned packages: items per (package, category, pos), and a log of what each version added and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import category_order


def append_new(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left, then the rows of right whose exact content (keys, content) it lacks, each once, in order of pos."""
    once = right.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "content").orderBy("pos"))).filter("_r = 1").drop("_r")
    fresh = once.join(left.select(*keys, "content").distinct(), [*keys, "content"], "left_anti")
    ends = left.groupBy(*keys).agg((F.max("pos") + 1).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    fresh = fresh.withColumn("pos", place).join(ends, keys, "left").withColumn("pos", (F.col("pos") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")
    return left.withColumn("pos", F.col("pos").cast("int")).unionByName(fresh.select(*left.columns))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with op `added` or `removed`, by id."""
    added = new.join(old.select(*keys, "id").distinct(), [*keys, "id"], "left_anti").withColumn("op", F.lit("added"))
    removed = old.join(new.select(*keys, "id").distinct(), [*keys, "id"], "left_anti").withColumn("op", F.lit("removed"))
    return added.unionByName(removed.select(*added.columns))


def remove_items(items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays, and what was removed."""
    wanted = ids.filter("id is not null and id <> ''").select("id").distinct()
    return items.join(wanted, "id", "left_anti"), items.join(wanted, "id", "left_semi")


def undo(items: DataFrame, log: DataFrame, current: int, target: int) -> DataFrame:
    """Items at an earlier version, by undoing the log (version, op, item columns) newest first.

    Of each id's events after the target the oldest decides: added there means gone, removed there means
    restored, at the end of its category.
    """
    if not 1 <= target < current:
        raise ValueError("target version must lie before the current one")
    later = log.filter((F.col("version") > target) & (F.col("version") <= current))
    first = later.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("version", F.desc("op")))).filter("_r = 1")
    stays = items.join(first.select("id"), "id", "left_anti")
    back = first.filter("op = 'removed'")
    ends = stays.groupBy("category").agg((F.max("pos") + 1).alias("_n"))
    order = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("version"), "pos")) - 1
    back = back.withColumn("pos", order).join(ends, "category", "left").withColumn("pos", (F.col("pos") + F.coalesce("_n", F.lit(0))).cast("int"))
    return stays.withColumn("pos", F.col("pos").cast("int")).unionByName(back.select(*items.columns))


def version_summary(versions: DataFrame, log: DataFrame) -> DataFrame:
    """Added and removed per version, oldest first; versions without changes have zeros."""
    n = log.groupBy("version").agg(F.count_if(F.col("op") == "added").alias("added"), F.count_if(F.col("op") == "removed").alias("removed"))
    return versions.join(n, "version", "left").fillna(0, ["added", "removed"]).orderBy("version")


def flatten(items: DataFrame) -> DataFrame:
    return items.orderBy(category_order(F.col("category")), "pos")


def by_id(items: DataFrame) -> DataFrame:
    """One row per id, the last in order of category and pos."""
    place = F.struct(category_order(F.col("category")).alias("o"), F.col("pos"))
    cols = [c for c in items.columns if c != "id"]
    return items.groupBy("id").agg(F.max_by(F.struct(*cols), place).alias("x")).select("id", "x.*")


def counts(items: DataFrame) -> DataFrame:
    """Items per category, zeros kept."""
    from ..functions.constants import CATEGORIES

    dim = items.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return dim.join(items.groupBy("category").agg(F.count("*").alias("n")), "category", "left").fillna(0, ["n"])
