"""Exact n-gram Jaccard self-join by vertical partitioning.

Words are lower-cased (A-Z) runs of other than ASCII white space; a document's set holds the hashes of its
n-word shingles. Shingles have one global order: by how often they occur (rare first; levels of the KEPT_CELLS most frequent of
2**CELL_BITS cells of hashes, counted over all documents; all others share one level), then by hash. Two documents at or over the threshold share
a shingle within their prefixes of that order, and the first they share leaves room for the overlap
needed (prefix, size and position filters; none loses a pair).

1. Equal sets meet under one set id (a 64-bit digest), so copies cost a row each and no pair.
2. Prefix shingles go, packed, to buckets of the order's hash; a shingle held by few sets gives all pairs
   that pass the filters, one held by more gives a star around one set and a chain in order of size.
3. Candidate pairs whose parity sketches differ in more cells than linked sets could are dropped (the sketches'
   difference never exceeds the sets'). The rest are verified by vertical partitioning: the sets are cut, by pivots of the global
   order, into FRAGMENTS, which are dealt to tasks each for itself; a task counts the overlaps of pairs in its fragment alone,
   and the partial counts are summed per pair. Fragments carry DIGEST_BYTES of each shingle's hash.
4. Linked sets are joined to components (large star, small star). Where long lists still hold sets of
   different components, those of up to PAIR_LIST sets give all pairs across components that pass the filters, which are verified like
   the others: lists that have single sets in common chain most of a large table together, and such a chain is not compared with itself.
   The sets of still longer lists form regions; all of a region but its largest component is
   compared, block by block, with the whole region over an index of the block's shingles, one fragment after the
   other in the block's task (partial counts of all pairs would grow with the square of a region), and the components
   are joined again. Only links that join components come out, so no link between components is missed, and no
   group's pairs are all made.

Edge cases: null texts, empty texts and texts of white space have an empty set and link with nothing; a text of
fewer words than n has one shingle, the whole sequence; rows may repeat, and a doc_id may recur with
other texts (each row is judged by its own text); a null doc_id keeps its row, with its component's
smallest id or null; very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shuffle_parts, small_batches, worker_cache, written

WORDS = 5
#: The threshold as a fraction.
NUM, DEN = 75, 100
FRAGMENTS = 4
#: Two shingles of a pair that differ pass for equal in 2**48 cases: for two sets of 20,000 at odds of about one in a million.
DIGEST_BYTES = 6
#: Cells that shingles are counted in, those of a block that one task sums, and the most that get a level of their own. With 2**22
#: cells for all levels, tables of hundreds of millions of shingles had no order: every cell held as much as any other.
CELL_BITS, BLOCK_BITS, KEPT_CELLS = 28, 20, 1 << 21
#: Cells that a task holds before it sends them on.
FLUSH_CELLS = 4_000_000
BLOOM_BITS = 25
#: Sets that a shingle's list pairs outright, and neighbours in the chain of a longer one.
SMALL_LIST, CHAIN = 8, 2
#: Sets of a list whose pairs across components are verified one by one; longer lists' sets are compared by regions.
PAIR_LIST = 128
#: In the sizes of a long list: the set may be the smaller of a pair.
EARLY = 1 << 31
#: Postings of a bucket, and of a task before it sends them on.
BUCKET_POSTINGS, FLUSH_POSTINGS = 500_000, 250_000
#: Spokes of a hub that one task compares at a time, and shingles in a block of a region.
HUB_SPOKES = 64
#: Bytes of fragments that a task holds before it sends them on.
FLUSH_BYTES = 4 << 20
#: Sets of a long list in one row.
LIST_ROWS = 512
BLOCK_SHINGLES = 1_000_000
#: Most cells of a set's parity sketch, as a power of two.
PARITY_BITS = 15
#: Edges that one task joins to components; beyond, they are joined in rounds over all tasks.
FEW_EDGES = 500_000
POSTING = np.dtype([("t", "<u4"), ("s", "<i8"), ("n", "<u4"), ("p", "<u2")])
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
NULL_ID = -(2**63)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * M1
        x = x ^ (x >> np.uint64(33))
        x = x * M2
        return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    ws = (text or "").encode("utf-8").lower().split()
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    k = min(words, len(ws))
    m = len(ws) - k + 1
    acc = np.full(m, k, dtype=np.uint64)
    for i in range(k):
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m])
    return np.unique(acc)


def set_id(s: np.ndarray) -> int:
    """63-bit id of a set; 0 for the empty one."""
    return (xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 or 1) if len(s) else 0


def parity(s: np.ndarray) -> bytes:
    """Whether each cell holds an odd number of a set's shingles: two cells a shingle or more, up to 2**PARITY_BITS."""
    bits = 1 << min(PARITY_BITS, max(6, (2 * len(s)).bit_length()))
    odd = np.bincount((mixed(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Cells whose parities differ, the longer sketch folded to the shorter: at most the symmetric difference of the sets."""
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def needed(a, b, num: int = NUM, den: int = DEN):
    """Least overlap of sets of these sizes: den * o >= num * (a + b - o)."""
    return -((-num * (a + b)) // (num + den))


def prefix_len(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -((-num * n) // den) + 1


class Order:
    """The global order: level of a shingle's cell (0 unless it is kept), then its hash; and its cuts into fragments."""

    def __init__(self, cells: np.ndarray, levels: np.ndarray, weights: np.ndarray):
        self.cells, self.levels = cells, levels
        self.before = np.concatenate([[0.0], np.cumsum(weights)[:-1]])
        self.weights = weights
        self.total = max(1.0, float(weights.sum()))

    def level(self, s: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(len(s), dtype=np.uint8)
        cell = (s >> np.uint64(64 - CELL_BITS)).astype(np.uint32)
        i = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[i] == cell, self.levels[i], np.uint8(0))

    def sort(self, s: np.ndarray) -> np.ndarray:
        return s[np.lexsort((s, self.level(s)))]

    def fragment(self, s: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
        level = self.level(s)
        # within a level by the hash
        at = (self.before[level] + self.weights[level] * (s.astype(np.float64) / 2.0**64)) / self.total
        return np.minimum((at * fragments).astype(np.int64), fragments - 1)


def pack_cells(cells: np.ndarray) -> list[tuple[int, bytes]]:
    """Per block: the places of its cells, one for each shingle, as steps from place to place, low bytes first."""
    cells = np.sort(cells)
    at = np.flatnonzero(np.diff(cells >> BLOCK_BITS, prepend=np.uint32(0xFFFFFFFF)))
    place = cells & np.uint32((1 << BLOCK_BITS) - 1)
    out = []
    for x, i in zip(np.split(place, at[1:]), at.tolist()):
        steps = np.diff(x, prepend=np.uint32(0)).astype("<u4")
        out.append((int(cells[i] >> BLOCK_BITS), zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)))
    return out


def unpack_cells(data: bytes) -> np.ndarray:
    """Places of a block's cells, one for each shingle."""
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u4").reshape(-1), dtype=np.int64)


def scan_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """A row per document (doc_id, th, sid, n), and rows that carry the cells of each task's sets."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache().clear()  # what earlier operators left in this worker
        seen: set[int] = set()
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pd.DataFrame:
            blobs = pack_cells(np.concatenate(held))
            held.clear()
            return pd.DataFrame({"doc_id": None, "th": None, "sid": None, "n": None, "block": [i for i, _ in blobs], "cells": [x for _, x in blobs]})

        for b in batches:
            rows = []
            for doc_id, th, text in zip(b["doc_id"].tolist(), b["th"].tolist(), b["text"]):
                s = shingles(text, words)
                sid = set_id(s)
                rows.append((doc_id, th, sid, len(s)))
                if sid and sid not in seen:
                    seen.add(sid)
                    held.append((s >> np.uint64(64 - CELL_BITS)).astype(np.uint32))
                    count += len(s)
            out = pd.DataFrame(rows, columns=["doc_id", "th", "sid", "n"])
            out["block"], out["cells"] = None, None
            yield out
            if count >= FLUSH_CELLS:
                yield flush()
                count = 0
        if held:
            yield flush()

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")
    return docs.select(ids, F.xxhash64("text").alias("th"), "text").mapInPandas(scan, "doc_id long, th long, sid long, n long, block int, cells binary")


def global_order(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum the tasks' cells; what comes to the driver is at most KEPT_CELLS cells of five bytes, whatever the input.

    Of each block those cells are kept that hold most, down to the least count (2 or more) that all fit of.
    """
    most = max(1, KEPT_CELLS >> (CELL_BITS - BLOCK_BITS))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
        held, count = [], 0
        for c in pdf["cells"]:
            held.append(unpack_cells(c))
            count += len(held[-1])
            if count >= len(total):
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, count = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        some = np.sort(total[total > 1])
        least = 2 if len(some) <= most else int(some[-most - 1]) + 1
        kept = np.flatnonzero(total >= least)
        level = np.minimum(np.floor(4 * np.log2(total[kept])), 255).astype(np.uint8)  # 2 gives 4
        weights = np.bincount(level, weights=total[kept].astype(np.float64), minlength=256)
        weights[0] = total.sum() - total[kept].sum()
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "places": [kept.astype("<u4").tobytes()], "levels": [level.tobytes()], "weights": [weights.tobytes()]})

    cells, levels, weights = [np.empty(0, np.uint32)], [np.empty(0, np.uint8)], np.zeros(256)
    found = scanned.filter("block is not null").select("block", "cells").groupBy("block").applyInPandas(add, "block int, places binary, levels binary, weights binary").collect()
    for r in sorted(found, key=lambda r: r["block"]):
        cells.append(np.frombuffer(r["places"], dtype="<u4") + np.uint32(r["block"] << BLOCK_BITS))
        levels.append(np.frombuffer(r["levels"], dtype=np.uint8))
        weights += np.frombuffer(r["weights"])
    return np.concatenate(cells), np.concatenate(levels), weights


def pack_postings(sids: np.ndarray, ns: np.ndarray, doc: np.ndarray, tokens: np.ndarray, place: np.ndarray) -> bytes:
    """Postings that stand set by set: the sets with their sizes and numbers of postings, then tokens and places."""
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    own, many = doc[start], np.diff(np.append(start, len(doc))).astype("<u4")
    return np.array([len(own), len(doc)], dtype="<u4").tobytes() + sids[own].tobytes() + ns[own].tobytes() + many.tobytes() + tokens.tobytes() + place.tobytes()


def unpack_postings(data: bytes) -> np.ndarray:
    sets, n = np.frombuffer(data, dtype="<u4", count=2).tolist()
    at = 8
    parts = []
    for dtype, count in (("<i8", sets), ("<u4", sets), ("<u4", sets), ("<u4", n), ("<u2", n)):
        parts.append(np.frombuffer(data, dtype=dtype, count=count, offset=at))
        at += parts[-1].nbytes
    out = np.empty(n, dtype=POSTING)
    out["s"], out["n"] = np.repeat(parts[0], parts[2]), np.repeat(parts[1], parts[2])
    out["t"], out["p"] = parts[3], parts[4]
    return out


def postings(docs: DataFrame, order, buckets: int, words: int = WORDS) -> DataFrame:
    """Packed prefix postings: bucket, data. A set is sent once per task, however many copies it has there."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache().clear()
        o = Order(*order.value)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        count = 0

        def flush() -> pd.DataFrame:
            size = np.array([len(s) for s, _, _ in held])
            tokens = mixed(np.concatenate([s for s, _, _ in held]))
            # a smaller position only weakens the filter
            place = np.minimum(np.concatenate([np.arange(n) for n in size]), 65535).astype("<u2")
            doc = np.repeat(np.arange(len(held)), size)
            b = ((tokens & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            b, doc, place, tokens = b[by], doc[by], place[by], (tokens[by] >> np.uint64(32)).astype("<u4")
            sids, ns = np.array([x for _, x, _ in held], dtype="<i8"), np.array([n for _, _, n in held], dtype="<u4")
            at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            held.clear()
            return pd.DataFrame({"bucket": b[at].astype(np.int32), "data": [pack_postings(sids, ns, *x) for x in zip(*(np.split(y, at[1:]) for y in (doc, tokens, place)))]})

        for batch in batches:
            for text in batch["text"]:
                s = shingles(text, words)
                sid = set_id(s)
                if not sid or sid in seen:
                    continue
                seen.add(sid)
                held.append((o.sort(s)[: prefix_len(len(s))], sid, len(s)))
                count += len(held[-1][0])
                if count >= FLUSH_POSTINGS:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return docs.select("text").mapInPandas(send, "bucket int, data binary")


def _passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size and position filter of postings pairs, a's set not the larger: room for the overlap from here on."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    room = np.minimum(na - a["p"], nb - b["p"])
    return (DEN * na >= NUM * nb) & ((NUM + DEN) * room >= NUM * (na + nb)) & (a["s"] != b["s"])


def list_pairs(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Candidate pairs of one bucket, and its long lists (id, place, sets, sizes with EARLY), cut to LIST_ROWS, for the check across components."""
    rec = rec[np.lexsort((rec["s"], rec["n"], rec["t"]))]
    keep = np.ones(len(rec), dtype=bool)
    keep[1:] = (rec["t"][1:] != rec["t"][:-1]) | (rec["s"][1:] != rec["s"][:-1])
    rec = rec[keep]
    start = np.flatnonzero(np.concatenate([[True], rec["t"][1:] != rec["t"][:-1]])) if len(rec) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(rec)))
    many = np.repeat(size, size)
    rec, start, size = rec[many > 1], None, size[size > 1]
    many = np.repeat(size, size)
    left, right = [], []
    for d in range(1, SMALL_LIST):
        same = (rec["t"][:-d] == rec["t"][d:]) & ((many[d:] <= SMALL_LIST) | (d <= CHAIN)) if len(rec) > d else np.empty(0, bool)
        i = np.flatnonzero(same)
        i = i[_passes(rec[i], rec[i + d])]
        left.append(rec["s"][i])
        right.append(rec["s"][i + d])
    long_lists = []
    for at, n in zip((np.cumsum(size) - size)[size > SMALL_LIST].tolist(), size[size > SMALL_LIST].tolist()):
        g = rec[at : at + n]
        # only a set early enough in its own prefix can be the smaller of a pair
        early = (NUM + DEN) * (g["n"].astype(np.int64) - g["p"]) >= 2 * NUM * g["n"].astype(np.int64)
        if not early.any():
            continue
        rank = mixed(g["s"].astype(np.uint64))
        hub = int(np.argmin(rank))
        a, b = g[:hub], g[hub + 1 :]
        a, b = a[_passes(a, np.broadcast_to(g[hub], a.shape))], b[_passes(np.broadcast_to(g[hub], b.shape), b)]
        left += [a["s"], np.full(len(b), g["s"][hub])]
        right += [np.full(len(a), g["s"][hub]), b["s"]]
        sizes = g["n"] | np.where(early, np.uint32(EARLY), np.uint32(0))
        with np.errstate(over="ignore"):
            # lists of the same sets are one if the same sets are early in them
            total = rank.sum() + (mixed(rank[early]).sum() if n <= PAIR_LIST else np.uint64(0)) + np.uint64(n)
            ident = int(mixed(np.array([total], dtype=np.uint64))[0] >> np.uint64(1))
        long_lists += [(ident, i, g["s"][i : i + LIST_ROWS], sizes[i : i + LIST_ROWS]) for i in range(0, n, LIST_ROWS)]
    a, b = np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pair[:, 0], pair[:, 1], long_lists


def candidates(posted: DataFrame) -> DataFrame:
    """Rows (a, b) of candidate pairs, and rows (gid, part, sets, sizes) of long lists, each list once per bucket."""
    fields = ["a", "b", "gid", "part", "sets", "sizes"]

    def pair_up(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, lists = list_pairs(np.concatenate([unpack_postings(d) for d in pdf["data"]]))
        lists = list({(i, at): (i, at, s.astype("<i8").tobytes(), n.astype("<u4").tobytes()) for i, at, s, n in lists}.values())
        blank = [None] * len(lists)
        out = {k: pd.array([*x.tolist(), *blank], dtype="Int64") for k, x in (("a", a), ("b", b))}
        blank = [None] * len(a)
        out["gid"], out["part"] = (pd.array([*blank, *(x[i] for x in lists)], dtype="Int64") for i in (0, 1))
        out["sets"], out["sizes"] = (pd.Series([*blank, *(x[i] for x in lists)], dtype=object) for i in (2, 3))
        return pd.DataFrame(out, columns=fields)

    return posted.groupBy("bucket").applyInPandas(pair_up, "a long, b long, gid long, part long, sets binary, sizes binary")


def id_test(ids: DataFrame, bits: int = BLOOM_BITS):
    """A test on arrays: a Bloom filter of fixed size over a long column `i`, broadcast; past its capacity it only lets more rows through."""
    spark = ids.sparkSession
    block = 20

    def at(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(x.astype(np.uint64))
        return (h >> np.uint64(64 - bits)).astype(np.int64), (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            on = np.unique(np.concatenate(at(b["i"].to_numpy(np.int64))))
            cut = np.flatnonzero(np.diff(on >> block, prepend=-1))
            yield pd.DataFrame([(int(x[0] >> block), (x & ((1 << block) - 1)).astype("<u4").tobytes()) for x in np.split(on, cut[1:]) if len(x)], columns=["block", "places"])

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << block, dtype=bool)
        for x in pdf["places"]:
            on[np.frombuffer(x, dtype="<u4")] = True
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bitmap": [zlib.compress(np.packbits(on).tobytes(), 1)]})

    whole = np.zeros(1 << bits, dtype=bool)
    for r in ids.select("i").mapInPandas(mark, "block int, places binary").groupBy("block").applyInPandas(either, "block int, bitmap binary").collect():
        whole[r["block"] << block : (r["block"] + 1) << block] = np.unpackbits(np.frombuffer(zlib.decompress(r["bitmap"]), dtype=np.uint8)).astype(bool)
    shared = spark.sparkContext.broadcast(np.packbits(whole))

    def test(x: np.ndarray) -> np.ndarray:
        on = shared.value
        bit = lambda p: on[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1
        p, q = at(x)
        return (bit(p) & bit(q)).astype(bool)

    return test


def id_filter(ids: DataFrame, bits: int = BLOOM_BITS):
    """id_test as a column function."""
    test = id_test(ids, bits)

    @F.pandas_udf("boolean")
    def member(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(test(x.to_numpy(np.int64)))

    return member


def with_texts(seats: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """seats (sid, ...) with the text of their sets; a repeated row of docs comes as often as it is there."""
    wanted = written(seats.join(reps, "sid"), "ngram-seats")
    member = id_filter(wanted.select(F.col("doc_id").alias("i")).distinct())
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")
    texts = docs.select(ids, "text").filter(member("doc_id")).withColumn("th", F.xxhash64("text"))
    return texts.join(wanted, ["doc_id", "th"]).drop("doc_id", "th")


def routes(pairs: DataFrame) -> DataFrame:
    """Rows (hub, salt, spoke): the end with the smaller mixed id is the hub, its spokes go in groups of about HUB_SPOKES."""
    hub_first = F.xxhash64("a") < F.xxhash64("b")
    routed = pairs.select(F.when(hub_first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(hub_first, F.col("b")).otherwise(F.col("a")).alias("spoke"))
    degree = routed.groupBy("hub").agg(F.ceil(F.count("*") / HUB_SPOKES).cast("int").alias("salts"))
    return written(routed.join(degree, "hub").select("hub", F.pmod(F.xxhash64("spoke"), "salts").cast("int").alias("salt"), "spoke"), "ngram-routes")


def seats_of(routed: DataFrame) -> DataFrame:
    """Rows (sid, hub, salt): a spoke once for each of its pairs, a hub once for each of its groups of spokes."""
    return routed.select(F.col("spoke").alias("sid"), "hub", "salt").unionByName(routed.select(F.col("hub").alias("sid"), "hub", "salt").distinct())


def may_link(routed: DataFrame, docs: DataFrame, reps: DataFrame, words: int = WORDS) -> DataFrame:
    """The routes whose sets' parity sketches leave room for the overlap needed; none of a linked pair goes.

    Sketches are made where the texts lie, for the candidates' sets alone, and sent instead of the texts.
    """
    parts = shuffle_parts(routed.sparkSession)
    seats = seats_of(routed)
    test = id_test(seats.select("sid").distinct().join(reps, "sid").select(F.col("doc_id").alias("i")))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"][test(b["doc_id"].to_numpy(np.int64))]:
                s = shingles(text, words)
                rows.append((set_id(s), len(s), parity(s)))
            yield pd.DataFrame(rows, columns=["sid", "n", "parity"])

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")
    sketches = docs.select(ids, "text").mapInPandas(sketch, "sid long, n long, parity binary")
    sketches = written(sketches.groupBy("sid").agg(F.max("n").alias("n"), F.max("parity").alias("parity")), "ngram-sketches")
    seated = seats.join(sketches, "sid").repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("sid") != F.col("hub"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, size = None, b"", 0
        for b in batches:
            out = []
            for hub, salt, sid, n, sketched in zip(*(b[k].tolist() for k in ("hub", "salt", "sid", "n", "parity"))):
                if sid == hub:
                    at, own, size = (hub, salt), sketched, n
                    continue
                if at != (hub, salt):
                    raise ValueError("a spoke came without its hub")
                if least_difference(own, sketched) <= n + size - 2 * needed(n, size):
                    out.append((hub, salt, sid))
            yield pd.DataFrame(out, columns=["hub", "salt", "spoke"])

    return written(seated.select("hub", "salt", "sid", "n", "parity").mapInPandas(compare, "hub long, salt int, spoke long"), "ngram-routes")


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, order, words: int = WORDS) -> DataFrame:
    """Pairs (a, b) at or over the threshold, by overlaps per fragment summed per pair.

    Each pair is routed to its hub; a hub's fragments go once to each of its groups of spokes, a spoke's to
    each of its pairs, every fragment to a task of its own. Only pairs that pass the parity sketches get that far.
    """
    parts = shuffle_parts(pairs.sparkSession)
    seats = seats_of(may_link(routes(pairs), docs, reps, words))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o = Order(*order.value)
        names = ["hub", "salt", "fragment", "sid", "size", "digests"]
        for b in batches:
            out, held = [], 0
            for hub, salt, sid, text in zip(b["hub"].tolist(), b["salt"].tolist(), b["sid"].tolist(), b["text"]):
                s = shingles(text, words)
                f = o.fragment(s)
                # the low bytes, in order, of each fragment; an empty one can't overlap
                for i in np.unique(f).tolist():
                    part = np.sort(s[f == i] & np.uint64((1 << (8 * DIGEST_BYTES)) - 1))
                    out.append((hub, salt, i, sid, len(s), part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :DIGEST_BYTES].tobytes()))
                held += DIGEST_BYTES * len(s)
                if held >= FLUSH_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    cuts = with_texts(seats, docs, reps).select("hub", "salt", "sid", "text").mapInPandas(cut, "hub long, salt int, fragment int, sid long, size long, digests binary")
    seated = cuts.repartition(parts, "hub", "salt", "fragment").sortWithinPartitions("hub", "salt", "fragment", F.col("sid") != F.col("hub"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, size, met = None, None, 0, set()
        for b in batches:
            out = []
            for hub, salt, fragment, sid, n, digests in zip(*(b[k].tolist() for k in ("hub", "salt", "fragment", "sid", "size", "digests"))):
                if at != (hub, salt, fragment):
                    at, own, met = (hub, salt, fragment), None, set()
                if sid in met:
                    continue  # a repeated row
                met.add(sid)
                raw = np.zeros((len(digests) // DIGEST_BYTES, 8), dtype=np.uint8)
                raw[:, :DIGEST_BYTES] = np.frombuffer(digests, dtype=np.uint8).reshape(-1, DIGEST_BYTES)
                s = raw.reshape(-1).view("<u8")
                if sid == hub:
                    own, size = s, n
                elif own is not None:  # else the hub has nothing in this fragment
                    i = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    if shared := int(np.count_nonzero(own[i] == s)):
                        out.append((min(hub, sid), max(hub, sid), shared, n + size))
            yield pd.DataFrame(out, columns=["a", "b", "n", "sizes"], dtype="int64")

    partial = seated.mapInPandas(count, "a long, b long, n long, sizes long")
    overlap = partial.groupBy("a", "b").agg(F.sum("n").alias("o"), F.max("sizes").alias("sizes"))
    return overlap.filter(F.lit(NUM + DEN) * F.col("o") >= F.lit(NUM) * F.col("sizes")).select("a", "b")


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """node, label (smallest node of its component), every node named. Up to `few` edges are joined in one
    task; more by alternating large and small stars until nothing moves."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    if e.count() <= few:

        def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parent: dict[int, int] = {}
            for b in batches:
                for u, v in zip(b["u"].tolist(), b["v"].tolist()):
                    x, y = root(parent, u), root(parent, v)
                    parent[max(x, y)] = min(x, y)
            nodes = list(parent)
            yield pd.DataFrame({"node": nodes, "label": [root(parent, x) for x in nodes]}, dtype="int64")

        return e.coalesce(1).mapInPandas(join, "node long, label long")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "cc")
        if after.count() == e.count() and not after.exceptAll(e).head(1):
            break
        remove(edges.sparkSession, e)
        e = after
    named = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return named.unionByName(named.select(F.col("label").alias("node"), "label").distinct())


def list_rows(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """gid, part, sid, n, early, label of the sets of long lists."""
    one = lists.groupBy("gid", "part").agg(F.first(F.struct("sets", "sizes")).alias("l")).select("gid", "part", "l.sets", "l.sizes")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            many = [len(x) // 8 for x in b["sets"]]
            n = np.frombuffer(b"".join(b["sizes"]), dtype="<u4").astype(np.int64)
            yield pd.DataFrame({"gid": np.repeat(b["gid"].to_numpy(np.int64), many), "part": np.repeat(b["part"].to_numpy(np.int64), many), "sid": np.frombuffer(b"".join(b["sets"]), dtype="<i8"), "n": n & (EARLY - 1), "early": n >= EARLY})

    rows = one.mapInPandas(unpack, "gid long, part long, sid long, n long, early boolean")
    rows = rows.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").select("gid", "part", "sid", "n", "early", F.coalesce("label", "sid").alias("label"))
    return written(rows, "ngram-lists")


def mixed_lists(rows: DataFrame) -> DataFrame:
    """gid, hub (its smallest set), sets of the lists that hold more than one component."""
    found = rows.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("sid").alias("hub"), F.count("*").alias("sets"))
    return found.filter("x < y").select("gid", "hub", "sets")


def list_candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that lists of up to PAIR_LIST sets hold and that may pass the size and position filters."""
    held = rows.join(mixed_lists(rows).filter(F.col("sets") <= PAIR_LIST).select("gid"), "gid").select("gid", "sid", "n", "early", "label")
    x, y = (held.select("gid", *[F.col(c).alias(f"{c}_{k}") for c in ("sid", "n", "early", "label")]) for k in ("x", "y"))
    # x is not the larger: it is early in its prefix, and so is y if they are as large
    before = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("sid_x") < F.col("sid_y")) & F.col("early_y"))
    room = F.lit(DEN) * F.col("n_x") >= F.lit(NUM) * F.col("n_y")
    met = x.filter("early_x").join(y, "gid").filter((F.col("label_x") != F.col("label_y")) & before & room)
    return met.select(F.least("sid_x", "sid_y").alias("a"), F.greatest("sid_x", "sid_y").alias("b")).distinct()


def regions(rows: DataFrame) -> DataFrame:
    """sid, n, label, region of the sets in lists of over PAIR_LIST sets that hold more than one component."""
    # a list's parts meet its hub apart from each other
    hubs = rows.select("gid", "part").distinct().join(mixed_lists(rows).filter(F.col("sets") > PAIR_LIST), "gid")
    held = rows.join(hubs, ["gid", "part"]).select("sid", "n", "label", "hub").distinct()
    held = written(held, "ngram-held")
    region = components(held.select(F.col("sid").alias("a"), F.col("hub").alias("b")))
    return written(held.select("sid", "n", "label").distinct().join(region.select(F.col("node").alias("sid"), F.col("label").alias("region")), "sid"), "ngram-regions")


def across_components(members: DataFrame, docs: DataFrame, reps: DataFrame, order, words: int = WORDS) -> DataFrame:
    """Links (a, b) that join components within the regions; from each pair of blocks at most a spanning set of them."""
    parts = shuffle_parts(members.sparkSession)
    sizes = members.groupBy("region", "label").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    big = sizes.groupBy("region").agg(F.max_by("label", F.struct("c", "label")).alias("big"), F.max(F.struct("c", "label", "t"))["t"].alias("bt"), F.sum("t").alias("t"))
    big = big.select("region", "big", *[F.ceil(x / BLOCK_SHINGLES).cast("int").alias(n) for n, x in (("rows", F.col("t")), ("cols", F.greatest(F.col("t") - F.col("bt"), F.lit(1))))])
    at = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    all_ = members.join(big, "region")
    base = all_.select("sid", "label", "region", at("rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), F.lit(False).alias("asks"))
    asks = all_.filter("label <> big").select("sid", "label", "region", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), at("cols").alias("col"), F.lit(True).alias("asks"))
    seated = with_texts(base.unionByName(asks), docs, reps).repartition(parts, "region", "row", "col").sortWithinPartitions("region", "row", "col", "asks", "sid")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o = Order(*order.value)
        at, block, index, met = None, [], None, set()

        def build():
            """Per fragment: the block's shingles in ascending order, and whose they are."""
            tokens = np.concatenate([s for _, _, s in block])
            owner = np.repeat(np.arange(len(block)), [len(s) for _, _, s in block])
            f = o.fragment(tokens)
            out = []
            for i in range(FRAGMENTS):
                t, w = tokens[f == i], owner[f == i]
                by = np.argsort(t, kind="stable")
                out.append((t[by], w[by]))
            return out, np.array([len(s) for _, _, s in block]), np.array([x for x, _, _ in block]), np.array([c for _, c, _ in block])

        for b in batches:
            links = []
            for sid, label, region, row, col, asks, text in zip(*(b[k].tolist() for k in ("sid", "label", "region", "row", "col", "asks", "text"))):
                if at != (region, row, col):
                    at, block, index, met, joined = (region, row, col), [], None, set(), {}
                if (asks, sid) in met:
                    continue  # a repeated row
                met.add((asks, sid))
                s = shingles(text, words)
                if not asks:
                    block.append((sid, label, s))
                    continue
                if not block:
                    continue
                index = index or build()
                parts_, size, who, comp = index
                f = o.fragment(s)
                overlap = np.zeros(len(block), dtype=np.int64)
                for i in range(FRAGMENTS):
                    mine, (t, w) = s[f == i], parts_[i]
                    lo, hi = np.searchsorted(t, mine, side="left"), np.searchsorted(t, mine, side="right")
                    n = hi - lo
                    if n.sum():
                        overlap += np.bincount(w[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(block))
                for j in np.flatnonzero((comp != label) & ((NUM + DEN) * overlap >= NUM * (size + len(s)))).tolist():
                    x, y = root(joined, label), root(joined, int(comp[j]))
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        links.append((min(sid, int(who[j])), max(sid, int(who[j]))))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return seated.select("sid", "label", "region", "row", "col", "asks", "text").mapInPandas(compare, "a long, b long").distinct()


def root(parent: dict[int, int], x: int) -> int:
    """Root of x, which is entered if it is new; paths are halved on the way."""
    parent.setdefault(x, x)
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def link(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th (hash of the text), sid, n_shingles, label (component), component_id for every row of docs (doc_id, text)."""
    with small_batches(docs.sparkSession):
        return _link(docs, words)


def _link(docs: DataFrame, words: int) -> DataFrame:
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    scanned = written(scan_sets(docs, words), "ngram-sets")
    sets = scanned.filter("block is null").select("doc_id", "th", "sid", "n")
    order = spark.sparkContext.broadcast(global_order(scanned))  # at most five bytes for each of KEPT_CELLS
    total = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(parts, -(-total // (4 * BUCKET_POSTINGS)))
    reps = written(sets.filter("sid <> 0").groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("sid", "r.doc_id", "r.th"), "ngram-reps")
    found = written(candidates(postings(docs, order, buckets, words)), "ngram-candidates")
    pairs = written(found.filter("a is not null").select("a", "b").distinct(), "ngram-pairs")
    edges = written(verify(pairs, docs, reps, order, words), "ngram-edges")
    labels = written(components(edges), "ngram-labels")
    lists = found.filter("gid is not null").select("gid", "part", "sets", "sizes")
    if lists.head(1):
        rows = list_rows(lists, labels)
        more = []
        pairs = written(list_candidates(rows), "ngram-list-pairs")
        if pairs.head(1):
            more.append(written(verify(pairs, docs, reps, order, words), "ngram-edges"))
        members = regions(rows)
        if members.head(1):
            more.append(written(across_components(members, docs, reps, order, words), "ngram-edges"))
        for x in more:
            edges = edges.unionByName(x)
        if more:
            labels = written(components(edges), "ngram-labels")
    whole = reps.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "doc_id", F.coalesce("label", "sid").alias("label"))
    least = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = written(whole.join(least, "label").select("sid", "label", "component_id"), "ngram-named")
    out = sets.join(named, "sid", "left")
    return out.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "th", "sid", F.col("n").alias("n_shingles"), "label",
        F.when(F.coalesce("component_id", "doc_id") != NULL_ID, F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with one row of each group of linked documents, that of the smallest doc_id; rows without words stay.

    Of rows that repeat a doc_id and its text one stays, the first in order of all its columns (maps apart). Columns
    keep their names and values, whatever they are; an empty table gives an empty result.
    """
    from pyspark.sql.window import Window

    links = link(docs.select("doc_id", "text"), words)
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    linked = links.filter("sid <> 0").groupBy("label").agg(F.min(F.struct(ids.alias("_i"), F.col("th").alias("_h"))).alias("r")).select("r._i", "r._h", F.lit(True).alias("_one"))
    empty = links.filter("sid = 0").select(ids.alias("_i"), F.col("th").alias("_h"), F.lit(False).alias("_one")).distinct()
    kept = linked.unionByName(empty)
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns]).alias("d").join(kept.alias("k"), (ids == F.col("k._i")) & (F.xxhash64("d.text") == F.col("k._h")))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    flat = rows.select(*[c.alias(n) for c, n in zip(own, names)], F.col("k._i").alias("_i"), F.col("k._h").alias("_h"), F.col("k._one").alias("_one"))
    order = [F.col(n) for n, f in zip(names, docs.schema) if "map<" not in f.dataType.simpleString()] or [F.lit(1)]
    # a repeated row stands once
    first = flat.withColumn("_r", F.row_number().over(Window.partitionBy("_i", "_h").orderBy(*order))).filter("_r = 1 or not _one")
    return first.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
