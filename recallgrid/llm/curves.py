"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected at random to a few dimensions, each axis is stretched so that a sample's rows lie evenly
along it (dense clusters get room), shifted, and the rows are ordered along a Hilbert curve. Each curve has a
projection and a shift of its own. An ordering is cut into ranges at a sample's quantiles; a query goes to its
own range and the two beside it, and looks at the rows of its key window there, so no neighbour is lost at a
border. Windows work on coarse codes (a byte a component); their finds merge over the curves, and the best
are ranked by the exact cosine of the vectors as they are.

Curves come in rounds of ROUND_CURVES, to whose ranges rows are dealt once. A sample of SAMPLE_QUERIES queries then
tells how wide windows must be: their true cosines are known from one scan over all rows, a find counts if it comes up
to the last of these, and the first of the windows in GROWTH by which the sample's recall reaches TARGET is the one that
all queries look at, once. Where the widest is not enough on codes (clusters so dense that codes can't tell their rows
apart, or too many rows without any structure), whole vectors are looked at instead, on more curves each round and from
wider windows on. Not to reach the recall within MOST_ROUNDS is an error. On rows without structure the windows must
grow with the table, so the cosines taken are a share of all pairs, whatever the curves; rows are dealt once a round, and
rounds are few as each starts with twice the window of the one before.

Equal vectors are indexed once, with the smallest k + 1 of their ids, so a vector held by a third of all
rows is one point and a query's ties go to the smallest ids.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without id; vectors of different lengths are not compared, each length is searched for itself; components as
large or small as doubles allow are scaled by powers of two first; fewer candidates than k give fewer rows; ids
that recur are separate rows to the candidates but one query; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remove, shuffle_parts, written

ROUND_CURVES, PROJECTED, KEY_BITS, SALT_BITS = 8, 8, 6, 15
#: Rows on either side that a query looks at, the most that this grows to, and rows of a range.
WINDOW, MOST_WINDOW = 1024, 65_536
RANGE_WINDOWS = 8
#: Windows that a round may take, as multiples of its first; a range holds the last.
GROWTH = (1, 2, 3, 4, 6, RANGE_WINDOWS)
#: Finds that a window reports and that are ranked exactly, as multiples of k + 1.
REPORT, RERANK = 4, 8
#: Recall that the sample must reach, and its queries.
TARGET, SAMPLE_QUERIES = 0.95, 64
MOST_ROUNDS = 40
#: Rows that axes are stretched by, and keys that ranges are cut by.
AXIS_SAMPLE, KEY_SAMPLE, KNOTS = 4096, 100_000, 513
TASK_ROWS = 1_000_000
FOUND = "q long, v long, score double"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (integers under 2**bits per axis) along the Hilbert curve, by Gray-code untwisting of the axes."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows multiplied by powers of two, so that their largest component is near one and squares stay finite."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=-1, keepdims=True))[1])


def unit(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.linalg.norm(m, axis=-1, keepdims=True)


def cosines(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Cosine of one vector, or of each row's own, with each row, in double precision on the vectors as they are, summed from the first component on."""
    q, m = scaled(np.atleast_2d(q)), scaled(m)
    dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
    return np.clip(dot(q, m) / np.sqrt(dot(q, q) * dot(m, m)), -1, 1)


def cosine(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(cosines(_matrix(x), _matrix(y)) if len(x) else [], dtype="float64")

    return of(a, b)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.empty((0, 0))


class Curves:
    """Orderings of unit vectors: projections, and per axis the knots that spread a sample's rows evenly."""

    def __init__(self, sample: np.ndarray, first: int, count: int):
        dim = sample.shape[1]
        self.axes = min(PROJECTED, dim)
        self.turn, self.knots, self.shift = [], [], []
        at = np.linspace(0, 1, KNOTS)
        for c in range(first, first + count):
            rng = np.random.default_rng(1000 + c)
            turn = np.linalg.qr(rng.standard_normal((dim, self.axes)))[0]
            self.turn.append(turn)
            self.knots.append(np.quantile(sample @ turn, at, axis=0))
            self.shift.append(rng.random(self.axes) / 2)

    def keys(self, units: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        """Per curve: the place of each row along it, then bits of its id, so that rows in one cell can be cut apart."""
        with np.errstate(over="ignore"):
            salt = ((v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SALT_BITS)).astype(np.int64)
        out = []
        at = np.linspace(0, 1, KNOTS)
        for turn, knots, shift in zip(self.turn, self.knots, self.shift):
            p = units @ turn
            x = np.stack([np.interp(p[:, i], knots[:, i], at) for i in range(self.axes)], axis=1) / 2 + shift
            cells = np.minimum((x * (1 << KEY_BITS)).astype(np.int64), (1 << KEY_BITS) - 1)
            out.append((hilbert_keys(cells, KEY_BITS) << SALT_BITS) | salt)
        return out


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(f"`{vec_col}`").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(ok)


def distinct_vectors(rows: DataFrame, k: int, every: int) -> DataFrame:
    """Distinct vectors: v (their smallest id), ids (the smallest k + 1), vec, query (whether any id is one). Copies meet in each task first."""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[list[int], list[bool]]] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(i, np.frombuffer(b, dtype="<f8"), asks[0]) for b, (ids, asks) in held.items() for i in sorted(ids)[: k + 1]], columns=["id", "vec", "query"])
            held.clear()
            return out

        for b in batches:
            for i, v in zip(b["id"].tolist(), b["vec"]):
                raw = (np.asarray(v, dtype="<f8") + 0.0).tobytes()
                ids, asks = held.setdefault(raw, ([], [False]))
                ids.append(i)
                asks[0] |= i % every == 0
                if len(ids) > 4 * (k + 1):
                    ids[:] = sorted(ids)[: k + 1]
            if len(held) > 50_000:
                yield flush()
        if held:
            yield flush()

    few = rows.mapInPandas(combine, "id long, vec array<double>, query boolean")
    top = few.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).withColumn("query", F.max("query").over(Window.partitionBy("vec"))).filter(F.col("r") <= k + 1)
    return top.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("query").alias("query")).select(F.col("ids")[0].alias("v"), "ids", "vec", "query")


def sample_truth(points: DataFrame, k: int) -> dict[int, tuple[list[float], int, float]]:
    """Of a sample of queries: the vector, the number of its k + 1 nearest points (itself is one), and the last one's cosine, by one scan over all rows."""
    drawn = points.filter("query").orderBy(F.xxhash64("v"), "v").limit(SAMPLE_QUERIES).select("v", "vec").collect()
    asked = np.array([r["v"] for r in drawn], dtype=np.int64)
    shared = points.sparkSession.sparkContext.broadcast((asked, unit(np.array([r["vec"] for r in drawn], dtype=np.float64))))  # SAMPLE_QUERIES vectors

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(qid)
        for b in batches:
            if not len(b):
                continue
            v, s = b["v"].to_numpy(np.int64), q @ unit(_matrix(b["vec"])).T
            for j in range(len(qid)):
                scores, ids = np.concatenate([best[j][0], s[j]]), np.concatenate([best[j][1], v])
                top = np.lexsort((ids, -scores))[: k + 1]
                best[j] = scores[top], ids[top]
        out = [(int(qid[j]), i, x) for j, (scores, ids) in enumerate(best) for i, x in zip(ids.tolist(), scores.tolist())]
        if out:
            yield pd.DataFrame(out, columns=["q", "v", "score"])

    rank = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    top = points.select("v", "vec").mapInPandas(scan, FOUND).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k + 1)
    floors = {r["q"]: (r["n"], r["s"]) for r in top.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("s")).collect()}
    return {r["v"]: (r["vec"], *floors[r["v"]]) for r in drawn}


def sample_recall(points: DataFrame, best: DataFrame, truth: dict[int, tuple[list[float], int, float]], k: int) -> float:
    """Share of the sample's true neighbours that finds come up to, by the exact cosine."""
    found = F.broadcast(best.filter(F.col("q").isin(list(truth))).select("q", "v"))  # SAMPLE_QUERIES * RERANK * (k + 1) rows at most
    got = dict.fromkeys(truth, 0)
    vecs = {q: np.array(vec, dtype=np.float64) for q, (vec, _, _) in truth.items()}
    for r in points.select("v", "vec").join(found, "v").collect():
        got[r["q"]] += cosines(vecs[r["q"]], np.array([r["vec"]], dtype=np.float64))[0] >= truth[r["q"]][2] - 1e-9
    return sum(min(got[q], n) for q, (_, n, _) in truth.items()) / max(1, sum(n for _, n, _ in truth.values()))


def deal_rows(points: DataFrame, n: int, curves: Curves, count: int, window: int, whole: bool = False) -> DataFrame:
    """Rows in the ranges of `count` curves, with codes or whole vectors; a query also where its widest window reaches, from the window `least` on."""
    spark = points.sparkSession
    # plain values, as workers have no module to unpickle a class from: a few projections, and KNOTS a curve and axis
    shared = spark.sparkContext.broadcast((curves.turn, curves.knots, curves.shift, curves.axes))

    def opened() -> Curves:
        c = Curves.__new__(Curves)
        c.turn, c.knots, c.shift, c.axes = shared.value
        return c

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = opened()
        for b in batches:
            if len(b):
                found = c.keys(unit(_matrix(b["vec"])), b["v"].to_numpy(np.int64))
                yield pd.DataFrame({"curve": np.arange(count), "keys": [x.astype("<i8").tobytes() for x in found]})

    draw = F.pmod(F.xxhash64("v"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    seen = points.filter(draw < min(1.0, KEY_SAMPLE / max(1, n))).select("v", "vec").mapInPandas(keys, "curve int, keys binary").toPandas()
    ranges = max(1, min(-(-n // (RANGE_WINDOWS * window)), KEY_SAMPLE // 8))
    along = [np.sort(np.frombuffer(b"".join(map(bytes, seen["keys"][seen["curve"] == c])), dtype="<i8")) for c in range(count)]
    edges = spark.sparkContext.broadcast(along)  # KEY_SAMPLE keys a curve
    borders = lambda keys: (np.linspace(0, 1, ranges + 1) * len(keys)).astype(np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = opened()
        for b in batches:
            if not len(b):
                continue
            u, v, asks = unit(_matrix(b["vec"])), b["v"].to_numpy(np.int64), b["query"].to_numpy(bool)
            size = np.abs(u).max(axis=1) / 127
            if whole:
                code, size = u, np.ones(len(u))
            else:
                code = np.rint(u / size[:, None]).astype(np.int8)
            codes = np.array([x.tobytes() for x in code], dtype=object)
            who = np.flatnonzero(asks)
            for i, key in enumerate(c.keys(u, v)):
                keys_, at = edges.value[i], borders(edges.value[i])
                block = np.searchsorted(keys_[at[1:-1]], key, side="right")
                place = np.searchsorted(keys_, key, side="right")
                # a query is a guest where its window reaches over the border, by its place among the sample's keys
                slack = 8 if len(keys_) < n else 0
                rows, spot, guest, least = [np.arange(len(b))], [block], [np.zeros(len(b), bool)], [np.zeros(len(b), np.int64)]
                for step in (-1, 1):
                    far = np.abs(place - at[block + (step > 0)])
                    need = np.ceil(np.maximum(0, far - slack) * n / (1.5 * len(keys_))).astype(np.int64)
                    on = who[((block + step >= 0) & (block + step < ranges) & (need <= GROWTH[-1] * window))[who]]
                    rows.append(on)
                    spot.append(block[on] + step)
                    guest.append(np.ones(len(on), bool))
                    least.append(need[on])
                at = np.concatenate(rows)
                yield pd.DataFrame({"spot": np.concatenate(spot) + i * ranges, "guest": np.concatenate(guest), "least": np.concatenate(least), "key": key[at], "v": v[at], "query": asks[at], "size": size[at].astype(np.float32), "code": codes[at]})

    parts = max(1, min(count * ranges, max(shuffle_parts(spark), count * n // TASK_ROWS)))
    dealt = points.select("v", "vec", "query").mapInPandas(deal, "spot long, guest boolean, least long, key long, v long, query boolean, size float, code binary")
    return dealt.repartition(parts, "spot").sortWithinPartitions("spot", "guest", "key", "v")


def window_search(dealt: DataFrame, k: int, windows: list[int], only: list[int] | None = None, whole: bool = False) -> DataFrame:
    """Finds (q, v, score of the codes, or of whole vectors, window) of every query, or of only some, within each of these key windows on all curves."""
    most = REPORT * (k + 1)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def look(b: pd.DataFrame) -> pd.DataFrame:
            guest, asks = b["guest"].to_numpy(bool), b["query"].to_numpy(bool)
            code = np.frombuffer(b"".join(b["code"]), dtype=np.float64 if whole else np.int8).reshape(len(b), -1)
            code = code if whole else code.astype(np.float32)
            v, key, size, least = b["v"].to_numpy(np.int64), b["key"].to_numpy(np.int64), b["size"].to_numpy(np.float64), b["least"].to_numpy(np.int64)
            n = int((~guest).sum())
            out = []
            for j in np.flatnonzero(asks if only is None else asks & np.isin(v, only)):
                # a row's own place, or where a guest's key would stand
                at = j if j < n else int(np.searchsorted(key[:n], key[j]))
                for window in windows:
                    if least[j] > window:
                        continue
                    lo, hi = max(0, at - window), min(n, at + window + 1)
                    s = (code[lo:hi] @ code[j]).astype(np.float64) * size[lo:hi] * size[j]
                    top = np.argpartition(-s, most - 1)[:most] if len(s) > most else np.arange(len(s))
                    out.append((np.full(len(top), v[j]), v[lo + top], s[top], np.full(len(top), window)))
            cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
            return pd.DataFrame(dict(zip(("q", "v", "score", "window"), cols)))

        for b in batches:
            spot = b["spot"].to_numpy(np.int64)
            ends = np.flatnonzero(np.diff(spot)) + 1
            for x in np.split(np.arange(len(b)), ends):
                if not len(x):
                    continue
                part = b.iloc[x[0] : x[-1] + 1]
                if held and held[0]["spot"].iloc[0] != part["spot"].iloc[0]:
                    yield look(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield look(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(search, FOUND + ", window long")


def search_points(points: DataFrame, k: int, target: float = TARGET, window: int = WINDOW, round_curves: int = ROUND_CURVES) -> DataFrame:
    """The best finds (q, v, score of the codes) of every query, RERANK * (k + 1) of them, once the sample's recall is reached."""
    n = points.count()
    truth = sample_truth(points, k)
    axis = points.orderBy(F.xxhash64("v", F.lit(1)), "v").limit(AXIS_SAMPLE).select("vec").collect()
    sample = unit(np.array([r["vec"] for r in axis], dtype=np.float64))
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    best, recall = None, 0.0

    def merged(found: DataFrame) -> DataFrame:
        found = found.select("q", "v", "score") if best is None else found.select("q", "v", "score").unionByName(best)
        return found.groupBy("q", "v").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= RERANK * (k + 1)).drop("r")

    for done in range(MOST_ROUNDS):
        whole = done > 0
        if whole:
            window = min(MOST_WINDOW, 2 * window)
        dealt = deal_rows(points, n, Curves(sample, done * round_curves, round_curves), round_curves, window, whole).persist(StorageLevel.DISK_ONLY)
        windows = [window * x for x in GROWTH if x == 1 or window * (x - 1) < n]
        tried = written(window_search(dealt, k, windows, list(truth), whole), "ann-tried")  # of SAMPLE_QUERIES queries
        for wide in windows:
            recall = sample_recall(points, merged(tried.filter(F.col("window") == wide)), truth, k)
            if recall >= target:
                break
        remove(points.sparkSession, tried)
        if whole or recall >= target:  # scores of codes and of vectors don't mix
            before, best = best, written(merged(window_search(dealt, k, [wide], None, whole)), "ann-finds")
            if before is not None:
                remove(points.sparkSession, before)
        dealt.unpersist()
        if recall >= target:
            return best
    raise RuntimeError(f"a recall of {recall:.3f} is reached after {MOST_ROUNDS} rounds of {round_curves} curves, not {target}")


def nearest(rows: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, target: float = TARGET, window: int = WINDOW, round_curves: int = ROUND_CURVES) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose id is divisible by `every`."""
    good = usable(rows, id_col, vec_col)
    asked = good.filter(F.col("id") % every == 0)
    out = None
    for r in asked.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect():  # as many as vectors have lengths
        same = F.size("vec") == r["d"]
        found = _nearest(good.filter(same), asked.filter(same), k, every, target, window, round_curves)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(good: DataFrame, queries: DataFrame, k: int, every: int, target: float, window: int, round_curves: int) -> DataFrame:
    points = written(distinct_vectors(good, k, every), "ann-points")
    seen = points.agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).first()
    if seen["n"] > seen["d"]:  # an id with several vectors: all but one get a number of their own
        r = F.row_number().over(Window.partitionBy("v").orderBy("vec"))
        points = written(points.withColumn("r", r).select(F.when(F.col("r") == 1, F.col("v")).otherwise(F.xxhash64("v", "r")).alias("v"), "ids", "vec", "query"), "ann-points")
    best = search_points(points, k, target, window, round_curves)
    of = points.filter("query").select(F.col("v").alias("q"), F.col("vec").alias("qvec"))
    # the true cosine of each find, and its rows: its ids, less the query's own
    near = best.join(points.select("v", "ids", "vec"), "v").join(of, "q").select("q", "ids", cosine(F.col("qvec"), F.col("vec")).alias("score"))
    near = near.select("q", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    rows_of = queries.select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).distinct().join(of.join(lists, "q").select(F.col("qvec").alias("vec"), "near"), "vec")
    mine = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return rows_of.select(F.col("id").alias("query_id"), F.posexplode(mine).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
