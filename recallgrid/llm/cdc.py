"""Document fingerprints by content-defined chunking.

A gear hash rolls over the text's UTF-8 bytes; a chunk ends where its high bits are zero. Chunking is
normalised: up to the expected size a stricter mask must match, beyond it a laxer one, with a least and
a greatest size. Boundaries depend on the last 32 bytes alone, so they shift along with the text. The
fingerprint is the set of chunk digests with the bytes each stands for; the likeness of two fingerprints
is the containment of the shared bytes in the larger of the two (`likeness`), or in a given one
(`containment`).

Edge cases: null and empty texts have an empty fingerprint, wholly alike with another empty one and not
at all with any other; a text of one chunk is alike only with texts that hold that chunk; a chunk that
recurs in a text counts once with its total length; very long texts are hashed in stretches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, written

EXPECTED, LEAST, MOST = 32, 8, 128
STRICT_BITS, LAX_BITS = 6, 4
STRETCH = 1 << 22
#: Rows of a task in the chained comparison, and the most tasks; a task streams, so its rows may be many.
PART_ROWS, MOST_PARTS = 20_000, 10_000


def _gear() -> np.ndarray:
    """256 random 32-bit words from a fixed digest chain."""
    return np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:4] for i in range(256)), dtype="<u4").astype(np.uint32)


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of GEAR[b] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    span = 1
    while span < 32:
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
        span *= 2
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if not n:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    lax = []
    strict = []
    for at in range(0, n, STRETCH):
        lead = min(31, at)
        h = gear_hash(raw[at - lead : at + STRETCH])[lead:]
        hit = np.flatnonzero(h < np.uint32(1 << (32 - LAX_BITS)))
        lax.append(hit + at + 1)
        strict.append(h[hit] < np.uint32(1 << (32 - STRICT_BITS)))
    ends, hard = np.concatenate(lax).tolist(), np.concatenate(strict).tolist()
    out = []
    start, i, m = 0, 0, len(ends)
    while start < n:
        low, mid, high = start + LEAST, start + EXPECTED, start + MOST
        while i < m and ends[i] < low:
            i += 1
        cut = min(high, n)
        while i < m and ends[i] <= cut:
            if hard[i] or ends[i] >= mid:
                cut = ends[i]
                break
            i += 1
        out.append(cut)
        start = cut
    return out


def chunk_set(text: str | None) -> dict[int, int]:
    """Chunk digest -> bytes it stands for."""
    data = (text or "").encode("utf-8")
    out: dict[int, int] = {}
    start = 0
    digest = xxhash.xxh3_64_intdigest
    for end in boundaries(data):
        d = digest(data[start:end])
        out[d] = out.get(d, 0) + end - start
        start = end
    return out


def pack_fingerprint(chunks: dict[int, int]) -> str:
    """Digests in ascending order, 8 bytes each, then the lengths, 4 bytes each, as base64."""
    keys = sorted(chunks)
    return base64.b64encode(np.array(keys, dtype="<u8").tobytes() + np.array([chunks[k] for k in keys], dtype="<u4").tobytes()).decode()


def unpack_fingerprint(fp: str) -> dict[int, int]:
    raw = base64.b64decode(fp)
    n = len(raw) // 12
    return dict(zip(np.frombuffer(raw[: 8 * n], dtype="<u8").tolist(), np.frombuffer(raw[8 * n :], dtype="<u4").tolist()))


def shared_bytes(a: dict[int, int], b: dict[int, int]) -> int:
    if len(b) < len(a):
        a, b = b, a
    return sum(min(n, b[k]) for k, n in a.items() if k in b)


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes in chunks that b has too."""
    total = sum(a.values())
    return shared_bytes(a, b) / total if total else float(not b)


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment of what is shared in the larger text: symmetric, 1 for equal texts."""
    most = max(sum(a.values()), sum(b.values()))
    return shared_bytes(a, b) / most if most else 1.0


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """All columns of docs and each text's fingerprint."""

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([pack_fingerprint(chunk_set(t)) for t in texts], dtype=object)

    own = [F.col(f"`{c}`") for c in docs.columns if c != out_col]
    return docs.select(*own, make(F.col(text_col)).alias(out_col))


EDITED_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by as many, or all, of the following text's first."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def compare_edited(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Fingerprints of every text, its edited text, and their likeness, in a chain by descending doc_id.

    Rows are dealt once into ranges of doc_id; the first row of each range goes along with the range
    before it as well, so each task chains its rows alone. A null doc_id comes last; ties are chained in
    order of their text.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"))
    n = ids.count()
    parts = max(1, min(n, MOST_PARTS, max(shuffle_parts(spark), -(-n // part_rows))))
    probs = [i / parts for i in range(1, parts)]
    cuts = sorted(set(ids.agg(F.percentile_approx("k", probs, 10_000)).first()[0] or [])) if probs and n else []
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    edges = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(np.int64), side="right"), dtype="int32")

    tops = {r["b"]: r["k"] for r in ids.groupBy(bucket("k").alias("b")).agg(F.max("k").alias("k")).collect()}  # a row per task
    if not tops:
        return spark.createDataFrame([], EDITED_SCHEMA)
    order = sorted(tops, reverse=True)
    # the first row of a range goes to the range before it too; the first range follows the last
    to = F.broadcast(spark.createDataFrame([(b, tops[b], order[i - 1]) for i, b in enumerate(order)], "b int, top long, to int"))
    rows = docs.select(key.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("b", bucket("k")).join(to, "b")
    own = F.struct(F.col("b").alias("b"), F.lit(False).alias("guest"))
    rows = rows.select("k", "doc_id", "text", F.explode(F.when(F.col("k") == F.col("top"), F.array(own, F.struct(F.col("to").alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(own))).alias("p"))
    dealt = rows.select("doc_id", "text", "k", "p.b", "p.guest").repartition(parts, "b").sortWithinPartitions(F.col("b"), F.col("guest"), F.desc("k"), "text")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that still lacks its following text
        done_bucket = None

        def close(row, text, fp):
            doc_id, own_text, own_fp = row
            edited = edited_text(own_text, text)
            efp = own_fp if edited == own_text else chunk_set(edited)
            return (doc_id, len(own_text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), pack_fingerprint(own_fp), pack_fingerprint(efp), likeness(own_fp, efp), likeness(own_fp, fp))

        for batch in batches:
            out = []
            for doc_id, text, b, guest in zip(batch["doc_id"], batch["text"], batch["b"], batch["guest"]):
                if guest and b == done_bucket:
                    continue  # a tie of the first row: the chain goes on with the first of them
                fp = chunk_set(text)
                if held is not None:
                    out.append(close(held, text, fp))
                held = (doc_id, text, fp)
                if guest:
                    held, done_bucket = None, b
            df = pd.DataFrame(out, columns=[c.split()[0] for c in EDITED_SCHEMA.split(", ")])
            df["doc_id"] = df["doc_id"].astype("Int64")
            yield df

    return dealt.mapInPandas(chain, EDITED_SCHEMA)
