"""Best-fit packing of tokenised documents into fixed-length sequences.

Bound-certified repacking: pieces are packed per partition by best-fit decreasing; dual feasible
functions give a lower bound on each partition's bins. A partition whose bin count equals its bound is
certified and gives up its emptiest bin alone; others give up bins with gaps, emptiest first. What was
given up is dealt anew over fewer partitions and packed again, until one partition holds the rest.

Edge cases: null and empty texts are one piece holding only the separator; repeated rows are packed as
often as they occur; very long texts are cut into full pieces; an empty table gives an empty result;
other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, small_batches, worker_cache, written

CAPACITY = 2048
SEPARATOR_ID = 0
#: Pieces that one task packs.
PART_PIECES = 50_000
#: Bins filled less than this are worth an exchange; a partition gives up at most this share of its pieces.
GAP_FILL, GIVE_UP = 0.995, 0.125
#: Words kept with their ids in a worker, and the longest of them in bytes.
CACHE_WORDS, CACHE_BYTES = 350_000, 48
#: Lower-cased bytes of letters, then of neither letters, digits nor white space.
WORD_AND_MARKS = re.compile(rb"([a-z\x80-\xff]+)([!-/:-@\[-`{-~]+)")

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: itself where it is printable, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in own]
    return {x: chr(x) for x in own} | {x: chr(256 + i) for i, x in enumerate(rest)}


class WordIds(dict):
    """Whitespace-free chunk -> its token ids, little-endian uint32.

    The tokenizer lower-cases, normalises and splits without ever crossing ASCII white space, so a
    text's ids are those of its chunks, one after another; likewise it always splits between letters and
    marks. A chunk of Latin letters is one word to the model, which is asked for it directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def _ids(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        low = text.lower()
        # precomposed Latin letters stay as they are under NFC, and keep their number under lower()
        if low.isalpha() and len(low) == len(text) and max(low) < "\u0250":
            ids = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, low.encode("utf-8"))))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        m = WORD_AND_MARKS.fullmatch(chunk)
        if m and m[1].decode("utf-8").isalpha():
            out = self[m[1]] + self[m[2]]
        else:
            out = self._ids(chunk)
        if len(chunk) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = out
        return out


def word_ids(path: str) -> WordIds:
    store = worker_cache()
    if ("ids", path) not in store:
        store["ids", path] = WordIds(path)
    return store["ids", path]


def encode(text: str | None, words: WordIds) -> bytes:
    data = (text or "").encode("utf-8")
    if b"<|" not in data:  # special tokens are told by their case
        data = data.lower()
    return b"".join(map(words.__getitem__, data.split()))


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds its ids as little-endian uint32 bytes."""
    end = np.asarray([SEPARATOR_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pa.default_memory_pool().release_unused()  # what earlier operators left in this worker
        words = word_ids(tokenizer_path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                data = encode(text, words) + end
                n = len(data) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    part = data[4 * at : 4 * (at + size)]
                    rows.append((doc_id, k, at, size, zlib.crc32(part), *([part] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item (lengths in descending order), and the number of bins."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_, used = 0, 0  # bit r of open_: a bin with r left
    for i, size in enumerate(lengths.tolist()):
        fits = open_ >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                open_ &= ~(1 << left)
        else:
            b, left, used = used, capacity, used + 1
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            stacks[left].append(b)
            open_ |= 1 << left
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Largest bound from two families of dual feasible functions: thresholds eps, and steps k."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    total, above = np.cumsum(count * x), np.cumsum(count[::-1])[::-1]
    best = -(-int(total[-1]) // capacity)
    for eps in np.unique(lengths[lengths <= capacity // 2]).tolist():
        # items over capacity - eps fill a bin, items under eps count nothing
        top = int(above[capacity - eps + 1]) if eps else 0
        mid = int(total[capacity - eps] - (total[eps - 1] if eps else 0))
        best = max(best, -(-(top * capacity + mid) // capacity))
    for k in range(1, 20):
        step = (k + 1) * x
        whole = step % capacity == 0
        # in units of 1 / (k * capacity): exact multiples keep their size, others are rounded down to steps of 1 / k
        value = np.where(whole, k * x, (step // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _pack_part(capacity: int, stage: int, last: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used)
        items = np.bincount(bins, minlength=used)
        give = np.zeros(used, dtype=bool)
        if not last:
            order = np.lexsort((np.arange(used), fill))
            order = order[fill[order] < GAP_FILL * capacity]
            if used == bound:
                order = order[:1]
            give[order[np.cumsum(items[order]) <= max(GIVE_UP * len(pdf), items[order[:1]].sum())]] = True
        part = int(pdf["part"].iloc[0])
        pdf["sequence_id"] = (stage << 56) + (part << 28) + bins
        pdf["offset"] = offsets
        pdf["settled"] = ~give[bins]
        pdf["part_bins"], pdf["part_bound"] = used, bound
        return pdf.drop(columns="part")

    return pack


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; part_bins and part_bound certify the last packing."""
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, capacity), capacity, part_pieces)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    with small_batches(pieces.sparkSession):
        pool = written(pieces, "pieces")
    schema = PIECE_SCHEMA + ", sequence_id long, offset long, settled boolean, part_bins long, part_bound long"
    done: list[DataFrame] = []
    stage = 0
    while (n := pool.count()) or not done:
        parts = max(1, -(-n // part_pieces))
        last = parts == 1
        key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(stage)), F.lit(parts)).cast("long")
        dealt = pool.select(*[c.split()[0] for c in PIECE_SCHEMA.split(", ")], key.alias("part"))
        packed = written(dealt.groupBy("part").applyInPandas(_pack_part(capacity, stage, last), schema), "packed")
        done.append(packed.filter("settled"))
        if last:
            break
        pool = packed.filter("not settled")
        stage += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("settled")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict:
    """Sequences used, and the lower bound from the lengths of all pieces."""
    rows = packed.groupBy("length").count().collect()  # at most `capacity` rows
    lengths = np.repeat([r["length"] for r in rows], [r["count"] for r in rows]).astype(np.int64)
    return {"sequences": packed.select("sequence_id").distinct().count(), "bound": lower_bound(lengths, capacity) if len(lengths) else 0}
