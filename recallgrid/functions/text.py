"""Column functions over text: tokens, estimates, ids, sentences, names, HTML. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CATEGORIES, NAME_LENGTH, PACKAGE_NAME, PROMPT_LABELS, STOPWORDS, UPLOAD_SUFFIXES


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def _one_of(words) -> str:
    """A pattern of these words, tried by first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(words):
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    return "|".join(f"{c}(?:{'|'.join(ends)})" for c, ends in by.items())


def stem_all(s: Column) -> Column:
    """Words between blanks without the endings -ies (as -y), -ing, -ed and -s."""
    s = F.regexp_replace(s, "(?<![^ ])([^ ]{3,})ies(?![^ ])", "$1y")
    return F.regexp_replace(s, "(?<![^ ])(?:([^ ]{4,})(?:ing|ed)|([^ ]{2,}[^ sui])s)(?![^ ])", "$1$2")


def term_text(c: Column) -> Column:
    """Indexed terms of a text, in order, between blanks. Each step runs over the whole text at once."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9+#._\- ]+", " ")
    s = F.regexp_replace(s, r"(?<![^ ])[+#._\-]+|[._\-]+(?![^ ])", "")
    return stem_all(F.regexp_replace(s, f"(?<![^ ])(?:[^ ]|{_one_of(STOPWORDS)})(?![^ ])", ""))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(term_text(c), F.lit("[^ ]+"), F.lit(0))


def estimate_tokens(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    words = F.regexp_count(s, F.lit(r"\S+"))
    guess = F.ceil((F.length(s) / F.lit(4.0) + words * F.lit(1.3)) / F.lit(2.0))
    return F.when(s == "", F.lit(0)).otherwise(F.greatest(F.lit(1), guess)).cast("long")


def normalise(c: Column) -> Column:
    """Lower case, white space collapsed and stripped."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def item_id(category: Column, content: Column) -> Column:
    return F.substring(F.sha1(F.concat(category, F.char(F.lit(31)), normalise(content)).cast("binary")), 1, 12)


def sentences(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+|\n+"), strip)
    return F.filter(parts, lambda s: F.length(s) > 10)


def user_messages(c: Column) -> Column:
    """What each user marker opens, up to the next assistant marker."""
    return F.regexp_extract_all(c, F.lit(r"(?is)(?:^|\n)\s*(?:User|Human|You|Me)\s*:\s*(.+?)(?=\n\s*(?:Assistant|AI|Claude|ChatGPT|System)\s*:|$)"), F.lit(1))


def clean(c: Column) -> Column:
    s = F.regexp_replace(strip(c), r"(?i)^(?:User|Human|You|Me)\s*:\s*", "")
    return F.when(F.length(s) > 300, F.concat(F.substring(s, 1, 297), F.lit("..."))).otherwise(s)


def html_text(c: Column) -> Column:
    for pattern, to in ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?i)<br\s*/?\s*>", "\n"), (r"(?i)</(p|div|h[1-6]|li|tr)>", "\n"), (r"<[^>]+>", " ")):
        c = F.regexp_replace(c, pattern, to)
    for entity, to in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(entity), F.lit(to))
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"  +", " "))


def role(c: Column) -> Column:
    r = F.lower(F.trim(c))
    return F.when(r.isin("assistant", "ai", "bot"), "assistant").when(r == "system", "system").otherwise("user")


TURNS = "array<struct<role:string,content:string>>"


def json_turns(c: Column) -> Column:
    """Turns of a JSON array of objects with role (user where it is missing) and content (empty); null for any other text."""
    each = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    text = lambda x, field: F.try_variant_get(x, f"$.{field}", "string")
    return F.transform(each, lambda x: F.struct(F.coalesce(text(x, "role"), F.lit("user")).alias("role"), F.coalesce(text(x, "content"), F.lit("")).alias("content")))


def transcript_turns(c: Column) -> Column:
    """Turns of a transcript: array of struct(role, content). A JSON array gives its messages as they are; plain text is cut where a line opens with a speaker."""
    who = r"(?:User|Human|Assistant|AI|System)\s*:"
    parts = F.filter(F.split(c, f"(?im)^(?={who})"), lambda p: p.rlike(f"(?i)^{who}"))
    said = lambda p: strip(F.regexp_replace(p, f"(?i)^{who}", ""))
    turns = F.filter(F.transform(parts, lambda p: F.struct(role(F.regexp_extract(p, "^([A-Za-z]+)", 1)).alias("role"), said(p).alias("content"))), lambda t: t["content"] != "")
    alone = F.array(F.struct(F.lit("user").alias("role"), strip(c).alias("content")))
    return F.coalesce(json_turns(c), F.when(F.size(parts) > 0, turns).otherwise(alone))


def preview(c: Column) -> Column:
    v = strip(c)
    return (
        F.when(v.contains("@") & ~v.contains(" "), F.concat(F.substring(F.substring_index(v, "@", 1), 1, 1), F.lit("***@"), F.regexp_replace(v, r"^[^@]*@", "")))
        .when(F.length(v) <= 6, F.repeat(F.lit("*"), F.length(v)))
        .otherwise(F.concat(F.substring(v, 1, 3), F.lit("…"), F.right(v, F.lit(2))))
    )


def luhn_ok(c: Column) -> Column:
    """Luhn check over the digits of a value of 13 to 19 digits."""
    d = F.reverse(F.filter(F.split(F.regexp_replace(c, r"[^0-9]", ""), ""), lambda x: x != ""))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int")))
    return F.size(d).between(13, 19) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)


def package_name_ok(c: Column) -> Column:
    n = strip(F.coalesce(c, F.lit("")))
    return n.rlike(PACKAGE_NAME) & ~n.contains("..")


def suggest_name(c: Column, fallback: str = "imported_context") -> Column:
    s = F.lower(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9]+", "_"), F.lit("_")))
    s = F.btrim(F.substring(s, 1, NAME_LENGTH), F.lit("_"))
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def safe_filename(c: Column) -> Column:
    base = F.regexp_extract(F.regexp_replace(c, r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    name = F.btrim(F.regexp_replace(base, r"[^A-Za-z0-9._\- ]+", "_"), F.lit(" ."))
    return F.when(name != "", F.substring(name, 1, 128))


def upload_ok(c: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(safe_filename(c), r"(\.[^.]*)$", 1)).isin(*UPLOAD_SUFFIXES), F.lit(False))


def category_order(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in CATEGORIES]), c)


def category_label(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in zip(CATEGORIES, PROMPT_LABELS) for x in pair])[c]


def reason(matched: Column, lexical: Column, embedding: Column | None = None) -> Column:
    """Why an item was selected. Scores (0 to 1) are rounded by their exact value, a tie to even; format_string would round their decimal notation."""
    terms = F.array_join(F.transform(F.slice(matched, 1, 6), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    said = F.when(F.size(matched) > 0, F.concat(F.lit("Matched "), terms, F.lit(" (lexical "), F.format_number(lexical, 2), F.lit(")"))).otherwise(F.lit("No query terms matched"))
    return said if embedding is None else F.concat(said, F.when(embedding.isNotNull(), F.concat(F.lit("; embedding similarity "), F.format_number(embedding, 2))).otherwise(F.lit("")))
