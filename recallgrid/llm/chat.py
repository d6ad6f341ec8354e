"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds content parts; a visitor (one CASE branch per part type) flattens them, in order, into
text: text parts are escaped, image, audio and document parts become numbered placeholders, and each
attachment is recorded with its reference and its expanded token count. A turn is

    <|turn|>ROLE<|text|>TEXT<|end|>

Escaping is reversible: each backslash is doubled, then a single backslash is put behind the first
character of every control string (ours and those of other common templates). A lone backslash behind
`<` or `[` and before the rest of a control string can thus only come from the second step.

Edge cases: a null text is empty; a null role is empty; turns that tie are ordered by role, then text;
repeated rows are repeated turns; a null conversation id is a conversation; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What follows the first character of a control string: of this template, then of other common ones.
CONTROL_TAILS = r"\||/?s>|/?INST\]|<SYS>>|</SYS>>"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that an attachment takes: an image per tile and at least one, audio per second, a document per page.
IMAGE_TILE_TOKENS, IMAGE_TILE, AUDIO_TOKENS_PER_SECOND, DOCUMENT_TOKENS_PER_PAGE = 256, 512, 25, 640

PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={CONTROL_TAILS})", r"$1\\")


def unescape(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, rf"([<\[])\\(?={CONTROL_TAILS})", "$1"), F.lit("\\\\"), F.lit("\\"))


def text_part(c: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(c, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def expanded_tokens(p: Column) -> Column:
    tiles = F.ceil(F.coalesce(p["width"], F.lit(1)) / IMAGE_TILE) * F.ceil(F.coalesce(p["height"], F.lit(1)) / IMAGE_TILE)
    return (
        F.when(p["type"] == "image", F.greatest(tiles, F.lit(1)) * IMAGE_TILE_TOKENS)
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(1)) * DOCUMENT_TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(p: Column, i: Column) -> Column:
    """Text of one part: escaped text, or a placeholder with the part's place in the message."""
    attached = p["type"].isin("image", "audio", "document")
    return F.when(attached, F.concat(F.lit("<|"), p["type"], F.lit(":"), i.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans over it (code points), attachments.

    `parts` is an array of PART_TYPE. Spans cover each loss-role text between its <|text|> and <|end|>.
    """
    body = F.array_join(F.transform(F.col(parts), lambda p, i: visit(p, i)), "")
    attachments = F.transform(
        F.filter(F.transform(F.col(parts), lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"]["type"].isin("image", "audio", "document")),
        lambda x: F.struct(x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"), x["i"].cast("int").alias("part"), expanded_tokens(x["p"]).alias("tokens")),
    )
    none = F.array().cast("array<struct<type:string,ref:string,part:int,tokens:bigint>>")
    who = F.coalesce(F.col(role), F.lit(""))
    said = messages.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), who.alias("role"), F.coalesce(body, F.lit("")).alias("body"), F.coalesce(attachments, none).alias("attachments")).alias("m"))
    laid = said.select("conv_id", "m", F.concat(F.lit(TURN), escape(F.col("m.role")), F.lit(TEXT)).alias("head")).select("conv_id", "m", "head", F.length("head").cast("long").alias("lead"), F.length("m.body").cast("long").alias("size"))
    # where each turn starts: a running sum over its conversation, on the partitioning that the grouping needs anyway
    upto = Window.partitionBy("conv_id").orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = laid.withColumn("to", F.sum(F.col("lead") + F.col("size") + len(END)).over(upto) - len(END))
    one = F.struct("m", F.concat("head", "m.body", F.lit(END)).alias("s"), (F.col("to") - F.col("size")).alias("start"), F.col("to").alias("end"))
    whole = laid.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("ts"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["s"]), "").alias("formatted"),
        F.transform(F.filter("ts", lambda t: t["m"]["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: F.transform(t["m"]["attachments"], lambda a: F.struct(t["m"]["turn"].alias("turn"), *[a[k].alias(k) for k in ("type", "ref", "part", "tokens")])))).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of struct(role, text), unescaped."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda s: s != "")
    return F.transform(turns, lambda s: F.struct(unescape(F.substring_index(F.substr(s, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"), unescape(F.substr(s, F.instr(s, TEXT) + len(TEXT))).alias("text")))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped, in order. Each is sought from the text's start; digest() reads long conversations turn by turn."""
    return F.transform(spans, lambda x: unescape(F.substr(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output, per conversation.

    Turns are cut out of the formatted text and get their places by a running sum; a loss span is read from the turn whose text
    starts where the span does. A span that starts in no turn's text is an error.
    """
    rows = formatted.withColumn("chars", F.length("formatted").cast("long"))
    turns = rows.select("conv_id", "chars", F.posexplode(F.filter(F.split("formatted", r"<\|end\|>"), lambda s: s != "")).alias("i", "s"))
    lead = F.instr("s", TEXT) - 1 + len(TEXT)
    upto = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.sum(F.length("s") + len(END)).over(upto) - F.length("s") - len(END)
    role = unescape(F.substring_index(F.substr("s", F.lit(len(TURN) + 1)), TEXT, 1))
    turns = turns.select("conv_id", "chars", "i", role.alias("role"), F.substr("s", lead + 1).alias("body"), (begin + lead).alias("start"))
    spans = rows.select("conv_id", F.explode("loss_spans").alias("x")).select("conv_id", "x.start", "x.end", F.lit(True).alias("masked"))
    met = turns.alias("t").join(spans.alias("x"), F.col("t.conv_id").eqNullSafe(F.col("x.conv_id")) & (F.col("t.start") == F.col("x.start")), "left")
    loss = F.when(F.col("masked"), unescape(F.substr("body", F.lit(1), (F.col("end") - F.col("t.start")).cast("int")))).otherwise(F.lit(""))
    read = met.select(F.col("t.conv_id").alias("conv_id"), "chars", F.struct("i", F.concat("role", F.lit("\n"), unescape(F.col("body")), F.lit("\n")).alias("said"), loss.alias("loss"), F.coalesce("masked", F.lit(False)).alias("masked")).alias("t"))
    read = read.groupBy("conv_id").agg(F.first("chars").alias("chars"), F.sort_array(F.collect_list("t")).alias("ts"), F.count_if("t.masked").alias("found"))
    read = read.select("conv_id", "chars", "ts", "found", F.array_join(F.transform("ts", lambda t: t["loss"]), "").alias("loss"))
    want = rows.select(F.col("conv_id").alias("c"), F.size("loss_spans").cast("long").alias("spans"))
    read = read.join(want, F.col("conv_id").eqNullSafe(F.col("c"))).filter(F.assert_true(F.col("found") == F.col("spans"), "a loss span lies outside the turns' texts").isNull())
    return read.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("ts", lambda t: t["said"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )
