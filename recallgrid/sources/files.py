"""Files to text: text, HTML, JSON and chat exports, archives, PDF placeholders."""

from __future__ import annotations

import io
import json
import zipfile
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_text, strip

EXPORT_NAME = "conversations.json"
MEMBER_SUFFIXES = (".txt", ".md", ".json")
SPEAKERS = {"user": "User", "assistant": "Assistant", "system": "System"}


def _content(message: dict | None) -> str:
    c = (message or {}).get("content")
    if isinstance(c, dict):
        return "\n".join(p for p in c.get("parts", []) if isinstance(p, str))
    return c if isinstance(c, str) else str(c) if c else ""


def walk_tree(mapping: dict) -> list[tuple[str, str]]:
    """role, text of an export's message tree, breadth first from its root; without a root, of all nodes in order."""
    speaker = lambda m: (m.get("author") or {}).get("role", "unknown")
    top = next((k for k, node in mapping.items() if node.get("parent") is None), None)
    if not top:
        said = [(speaker(m), _content(m)) for m in (n.get("message") for n in mapping.values()) if m and m.get("content")]
        return [x for x in said if x[1].strip()]
    out, seen, ahead = [], set(), deque([top])
    while ahead:
        k = ahead.popleft()
        if k in seen:
            continue
        seen.add(k)
        node = mapping.get(k, {})
        if (m := node.get("message")) and speaker(m) in SPEAKERS and _content(m).strip():
            out.append((speaker(m), _content(m)))
        ahead.extend(node.get("children", []))
    return out


def export_text(conversations: list[dict]) -> str:
    out = []
    for c in conversations:
        out.append(f"\n=== Conversation: {c.get('title', 'Untitled')} ===\n")
        out += [f"{SPEAKERS[r]}: {t}" for r, t in walk_tree(c.get("mapping") or {}) if r in SPEAKERS]
    return "\n\n".join(out)


def json_text(raw: str) -> str:
    try:
        data = json.loads(raw)
    except json.JSONDecodeError:
        return raw
    if isinstance(data, list) and data and isinstance(data[0], dict):
        said = [m for m in data if isinstance(m, dict)]  # what is no message is passed over
        try:
            if "mapping" in data[0] or "title" in data[0]:
                return export_text(said)
            if "role" in data[0]:
                return "\n\n".join(f"{str(m.get('role') or 'unknown').capitalize()}: {'' if m.get('content') is None else m['content']}" for m in said)
        except (AttributeError, TypeError):  # of another shape than its first entry promises: shown as it is
            pass
    return json.dumps(data, indent=2, ensure_ascii=False)


def zip_text(data: bytes) -> str:
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return data.decode("utf-8", "replace")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if found := next((n for n in names if EXPORT_NAME in n), None):
            return json_text(z.read(found).decode("utf-8", "replace"))
        texts = [z.read(n).decode("utf-8", "replace") for n in names if n.lower().endswith(MEMBER_SUFFIXES)]
        return "\n\n".join(texts) if texts else "Empty ZIP archive"


def pdf_text(data: bytes) -> str:
    try:
        from PyPDF2 import PdfReader
    except ImportError:
        return "[PDF text needs an optional reader that is not installed]"
    try:
        pages = [(i, p.extract_text() or "") for i, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1)]
    except Exception as e:  # a broken file becomes text, so that one file never fails an import
        return f"[PDF could not be read: {type(e).__name__}]"
    said = [f"[Page {i}]\n{t}" for i, t in pages if t.strip()]
    return "\n\n".join(said) if said else "[PDF without text]"


def _parsed(suffix: str, data: bytes) -> str:
    """A file's text; one that can't be parsed is told of in its place, so that it doesn't fail the others."""
    try:
        return zip_text(data) if suffix == "zip" else pdf_text(data) if suffix == "pdf" else json_text(data.decode("utf-8", "replace"))
    except Exception as e:  # whatever a broken or encrypted member raises
        return f"[{suffix.upper()} could not be read: {type(e).__name__}]"


def parse_files(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """name, text of binary files, by suffix. Text and HTML stay in the JVM; archives, JSON and PDF go through Arrow."""
    suffix = F.lower(F.regexp_extract(F.col(name), r"\.([^./\\]*)$", 1))
    base = files.select(F.col(name).alias("name"), F.col(content).alias("content"), suffix.alias("suffix"))
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    own = base.filter(~F.col("suffix").isin("zip", "json", "pdf")).select("name", F.when(F.col("suffix").isin("html", "htm"), html_text(plain)).otherwise(plain).alias("text"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [_parsed(s, bytes(c)) for s, c in zip(b["suffix"], b["content"])]
            yield pd.DataFrame({"name": b["name"], "text": pd.Series(texts, index=b.index, dtype=object)})

    other = base.filter(F.col("suffix").isin("zip", "json", "pdf")).mapInPandas(parse, "name string, text string")
    return own.unionByName(other)


def join_sections(parsed: DataFrame, keys: list[str], order: str = "name") -> DataFrame:
    """One text of several files: a header line before each that isn't blank."""
    section = F.concat(F.lit("--- File: "), "name", F.lit(" ---\n"), "text")
    said = parsed.filter(strip(F.col("text")) != "")
    return said.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), section.alias("s")))).alias("l")).select(*keys, F.array_join("l.s", "\n\n").alias("text"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter(~F.col("path").rlike(r"/\.[^/]*$"))
