"""Rendering of memories as prompt blocks: markdown, XML or plain, with preamble and footer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import category_label, category_order


def resolve_format(model: str | None) -> str:
    low = (model or "").lower()
    return next((f for k, f in C.MODEL_FORMATS if k in low), "markdown")


def display_name(model: str | None) -> str:
    low = (model or "").lower()
    return next((n for k, n in C.DISPLAY_NAMES if k in low), model or "the target model")


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def render(items: DataFrame, fmt: str, keys: list[str] | None = None) -> DataFrame:
    """keys, block: a memory's text. items: keys, category, pos, content."""
    keys = keys or []
    n = F.row_number().over(Window.partitionBy(*keys, "category").orderBy("pos"))
    line = {
        "markdown": F.concat(F.lit("- "), "content"),
        "xml": F.concat(F.lit("  <item>"), xml_escape(F.col("content")), F.lit("</item>")),
    }.get(fmt, F.concat(F.lit("  "), n.cast("string"), F.lit(". "), "content"))
    lines = items.withColumn("_l", line).groupBy(*keys, "category").agg(F.sort_array(F.collect_list(F.struct("pos", "_l"))).alias("ls"))
    label, cat = category_label(F.col("category")), F.col("category")
    body = F.array_join("ls._l", "\n")
    section = {
        "markdown": F.concat(F.lit("## "), label, F.lit("\n"), body),
        "xml": F.concat(F.lit("<"), cat, F.lit(">\n  <!-- "), label, F.lit(" -->\n"), body, F.lit("\n</"), cat, F.lit(">")),
    }.get(fmt, F.concat(F.lit("["), label, F.lit("]\n"), body))
    parts = lines.select(*keys, F.struct(category_order(cat).alias("o"), section.alias("s")).alias("p")).groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    if fmt == "xml":
        block = F.concat(F.lit("<context>\n"), F.array_join("ps.s", "\n"), F.lit("\n</context>"))
    else:
        block = F.array_join("ps.s", "\n\n")
    return parts.select(*keys, block.alias("block"))


def footer(name: str, version: int, source: str, shown: int, total: int, note: str = "") -> str:
    of = f" of {total}" if shown != total else ""
    return f'\n\n---\nContext: "{name}" v{version} | Source: {source or "unknown"} | Items: {shown}{of}' + (f" | {note}" if note else "")


def build(items: DataFrame, model: str, name: str, version: int, source: str = "", fmt: str | None = None, selected: DataFrame | None = None, note: str = "", preamble: bool = True) -> str:
    """The prompt of a package, or of a selection of it; empty without items. One package's text comes to the driver."""
    chosen = items if selected is None else selected
    row = render(chosen, fmt or resolve_format(model)).first()
    if row is None or not row["block"].strip():
        return ""
    total = items.count()
    return "\n".join([*([C.PREAMBLE] if preamble else []), row["block"], footer(name, version, source, chosen.count(), total, note)])


def paste_prompt(block: str, extras: Iterable[tuple[str, str]] = ()) -> str:
    extras = list(extras)
    rule = "=" * 60
    out = [C.PASTE_INTRO + (C.PASTE_FILES if extras else "") + C.PASTE_ASK, "", block]
    for title, body in extras:
        out += ["", rule, title, rule, body]
    return "\n".join([*out, "", "---", C.PASTE_END])
