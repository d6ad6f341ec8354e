"""Chat exports: arrays of conversations, each a tree of messages, read with JSON and VARIANT functions and joins.

A conversation's messages come breadth first from its root (the first node without a parent), siblings in the order
of their parent's list. That order is the one by (depth, place in a walk in depth), and both come from one walk
along the tree (down each node and up again), ranked by pointer doubling: as many joins as the walk's length has
binary digits, whether the tree is a chain or a bush.

Edge cases: a text that is no array of objects holds no conversation; where no node is a root, all nodes come in
their order; a node that recurs in lists of children counts under the first list that names it (lists in the order
of the nodes), children that don't exist are passed over, and what the root doesn't reach is left out; messages that
are blank or of other speakers than user, assistant and system are left out; a missing title is Untitled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..shared import remove, written

EXPORT = "array<struct<title:string,mapping:map<string,struct<parent:string,children:array<string>,message:struct<author:struct<role:string>,content:variant>>>>>"
ROLES = ("user", "assistant", "system")


def content_text(content: Column) -> Column:
    """Text of a message: the string parts of an object, a string as it is, the JSON of anything else."""
    parts = F.filter(F.try_variant_get(content, "$.parts", "array<variant>"), lambda p: F.schema_of_variant(p) == "STRING")
    joined = F.array_join(F.transform(parts, lambda p: F.try_variant_get(p, "$", "string")), "\n")
    kind = F.schema_of_variant(content)
    text = F.when(kind.startswith("OBJECT"), F.coalesce(joined, F.lit(""))).when(kind == "STRING", F.try_variant_get(content, "$", "string"))
    return F.when(content.isNull() | (kind == "VOID"), F.lit("")).otherwise(F.coalesce(text, F.to_json(content)))


def _parsed(exports: DataFrame, key: str, raw: str) -> DataFrame:
    """key, conv (place in the array), title, mapping."""
    each = F.posexplode(F.from_json(F.col(raw), EXPORT)).alias("conv", "c")
    return exports.select(F.col(key).alias("key"), each).filter(F.col("c").isNotNull()).select("key", "conv", F.coalesce("c.title", F.lit("Untitled")).alias("title"), F.col("c.mapping").alias("mapping"))


def _ranked(tour: DataFrame) -> DataFrame:
    """conv_key, at, with steps and balance from there to the walk's end, of all that reach it. tour: conv_key, at, next (null at the end), balance."""
    spark = tour.sparkSession
    state, ended = written(tour.withColumn("steps", F.lit(1)), "export-tour"), 0
    while True:
        now = state.agg(F.count_if(F.col("next").isNull()).alias("ended"), F.count_if(F.col("next").isNotNull()).alias("left")).first()
        # a round in which nothing ends was the last: what is left goes in circles
        if not now["left"] or now["ended"] == ended:
            return state.filter("next is null").select("conv_key", "at", "steps", "balance")
        ended = now["ended"]
        ahead = state.select("conv_key", F.col("at").alias("next"), F.col("next").alias("n2"), F.col("steps").alias("s2"), F.col("balance").alias("b2"))
        # a step to where no row is leads out of the tree, so its row goes
        longer = state.filter("next is not null").join(ahead, ["conv_key", "next"])
        longer = longer.select("conv_key", "at", F.col("n2").alias("next"), (F.col("balance") + F.col("b2")).alias("balance"), (F.col("steps") + F.col("s2")).alias("steps"))
        before, state = state, written(state.filter("next is null").unionByName(longer), "export-tour")
        remove(spark, before)


def export_messages(exports: DataFrame, key: str, raw: str) -> DataFrame:
    """key, conv, place, role, content of the messages of exports (key: no value recurs)."""
    parsed = _parsed(exports, key, raw)
    nodes = parsed.select(F.struct("key", "conv").alias("conv_key"), F.posexplode(F.map_entries("mapping")).alias("node", "e"))
    said = content_text(F.col("e.value.message.content"))
    nodes = nodes.select("conv_key", "node", F.col("e.key").alias("name"), F.col("e.value.parent").alias("parent"), F.col("e.value.children").alias("children"), F.col("e.value.message.author.role").alias("role"), said.alias("content"))
    nodes = written(nodes, "export-nodes")

    roots = nodes.groupBy("conv_key").agg(F.min(F.when(F.col("parent").isNull(), F.col("node"))).alias("root"))
    lists = nodes.select("conv_key", F.col("node").alias("over"), F.posexplode("children").alias("nth", "name"))
    edges = lists.join(nodes.select("conv_key", "name", "node"), ["conv_key", "name"]).groupBy("conv_key", "node").agg(F.min(F.struct("over", "nth")).alias("u"))
    edges = edges.join(roots.filter("root is not null"), "conv_key").filter("node <> root").select("conv_key", "node", "u.over", "u.nth")
    # a node's own way down has the number 2 * node, its way up 2 * node + 1
    nth = Window.partitionBy("conv_key", "over").orderBy("nth")
    sibling = edges.withColumn("after", F.lead("node").over(nth)).withColumn("first", F.row_number().over(nth) == 1)
    firsts = sibling.filter("first").select("conv_key", F.col("over").alias("node"), F.col("node").alias("child"))
    down = nodes.select("conv_key", "node").join(firsts, ["conv_key", "node"], "left").select("conv_key", (2 * F.col("node")).alias("at"), F.coalesce(2 * F.col("child"), 2 * F.col("node") + 1).alias("next"), F.lit(1).alias("balance"))
    up = sibling.select("conv_key", (2 * F.col("node") + 1).alias("at"), F.coalesce(2 * F.col("after"), 2 * F.col("over") + 1).alias("next"), F.lit(-1).alias("balance"))
    end = roots.filter("root is not null").select("conv_key", (2 * F.col("root") + 1).alias("at"), F.lit(None).cast("int").alias("next"), F.lit(-1).alias("balance"))
    ranked = _ranked(down.unionByName(up).unionByName(end))

    walked = ranked.filter("at % 2 = 0").select("conv_key", (F.col("at") / 2).cast("int").alias("node"), (-F.col("balance")).alias("depth"), (-F.col("steps")).alias("walk"))
    rootless = nodes.join(roots.filter("root is null"), "conv_key", "left_semi").select("conv_key", "node", F.lit(0).alias("depth"), F.col("node").alias("walk"))
    kept = nodes.filter(F.col("role").isin(*ROLES) & (strip(F.col("content")) != "")).select("conv_key", "node", "role", "content")
    told = kept.join(walked.unionByName(rootless), ["conv_key", "node"])
    place = F.row_number().over(Window.partitionBy("conv_key").orderBy("depth", "walk")) - 1
    return told.select("conv_key.key", "conv_key.conv", place.alias("place"), "role", "content")


def export_texts(exports: DataFrame, key: str, raw: str) -> DataFrame:
    """key, text: of each export the conversations in order, a banner with the title before each one's messages."""
    banner = F.concat(F.lit("\n=== Conversation: "), "title", F.lit(" ===\n"))
    heads = _parsed(exports, key, raw).select("key", "conv", F.lit(-1).alias("place"), banner.alias("line"))
    lines = export_messages(exports, key, raw).select("key", "conv", "place", F.concat(F.initcap("role"), F.lit(": "), "content").alias("line"))
    every = heads.unionByName(lines).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("conv", "place", "line"))).alias("l"))
    return every.select("key", F.array_join("l.line", "\n\n").alias("text"))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """key (the file), text of the export files under a path."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return export_texts(files.select(F.col("_metadata.file_path").alias("file"), "value"), "file", "value")
