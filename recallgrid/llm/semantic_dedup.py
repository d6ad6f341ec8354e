"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one vector kept a group.

Equal vectors are one point with a number of copies. k-means on unit vectors, fitted on a sample of at most
TRAIN_ROWS points, gives about CELLS_PER_ROOT * sqrt(points) cells. A point lives in the cell of its nearest centre
and is a guest of every other cell whose border is near: two points of cosine >= t are at most
sqrt(2 - 2t) apart, so of two linked points of different cells at least one is within half of that of the plane
between the two centres. That margin loses nothing, but in many dimensions nearly every cell is within it;
a difference of that length in no particular direction moves a point by 1/sqrt(d) of it towards a plane, so the margin
is MARGIN_SIGMAS times that, and never over the safe half. Whether it was enough is measured: for SAMPLE points the
linked rows are known from one scan over all points. Where fewer than TARGET of them were found, the margin doubles, until
it is the safe one.

Cells are cut into blocks of BLOCK points, so a cell that holds a third of all points is many tasks. A pair is
counted in one place: in the higher one of its two home cells if the other point is a guest there, else in the lower one.
Blocks give a number of links per point and a spanning forest of the linked points, never the pairs.
Products that come out within 1e-9 of the threshold are settled by the cosine of the original vectors.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without id, link with
nothing; vectors of different lengths are not compared; rows with equal vectors are linked copies, also when they
have the same id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, shuffle_parts, written
from .curves import _matrix, cosines, unit
from .ngram_join import components

COSINE = 0.9
#: Cells per square root of the number of points, the most cells (which bounds what is broadcast), and points they are fitted on.
CELLS_PER_ROOT, MOST_CELLS, TRAIN_ROWS, ITERATIONS = 2, 16_384, 32_768, 6
MARGIN_SIGMAS, SAMPLE, TARGET = 3.0, 256, 0.999
BLOCK = 1024
NEAR = 1e-9


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = ITERATIONS) -> np.ndarray:
    """k centres of unit rows, each the direction of its rows' sum; a centre left without rows takes a row far from its own."""
    rng = np.random.default_rng(13)
    centres = sample[rng.choice(len(sample), size=k, replace=False)]
    for _ in range(rounds):
        own, best = nearest_centres(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, best = [np.empty(0, np.int64)], [np.empty(0)]
    for i in range(0, len(points), 2048):
        s = points[i : i + 2048] @ centres.T
        own.append(s.argmax(axis=1))
        best.append(s.max(axis=1))
    return np.concatenate(own), np.concatenate(best)


def takes_part(v: Column) -> Column:
    """Whether a vector of doubles can link at all; null counts as no."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def points_of(good: DataFrame) -> DataFrame:
    """vec, v (smallest id), copies: distinct vectors."""
    return good.groupBy("vec").agg(F.min("id").alias("v"), F.count("*").alias("copies"))


def assigned(points: DataFrame, centres: np.ndarray, margin: float) -> DataFrame:
    """p, vec, copies, home and guest (the cells it visits) of each point."""
    sc = points.sparkSession.sparkContext
    gram = centres @ centres.T
    apart = np.sqrt(np.maximum(2 - 2 * gram, 0)) if len(centres) <= 2048 else None
    shared = sc.broadcast((centres, apart))  # MOST_CELLS centres at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, apart = shared.value
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.iloc[i : i + 1024]
                s = unit(_matrix(part["vec"])) @ centres.T
                home = s.argmax(axis=1)
                over = s[np.arange(len(s)), home][:, None] - s
                if apart is not None:
                    near = over <= margin * apart[home]
                else:
                    near = over <= 2 * margin  # no two centres are further apart than 2
                    r, c = np.nonzero(near)
                    near[r, c] = over[r, c] <= margin * np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", centres[home[r]], centres[c]), 0))
                near[np.arange(len(s)), home] = False
                yield part.assign(home=home, guest=[np.flatnonzero(x).astype(np.int32) for x in near])

    return points.mapInPandas(assign, "p long, vec array<double>, copies long, home int, guest array<int>")


def compare(threshold: float):
    """Links between two blocks of a cell: a (point), n (rows it is linked with), b (smallest point of its tree here)."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        cell, left, right, visit = int(rows["cell"].iloc[0]), int(rows["left"].iloc[0]), int(rows["right"].iloc[0]), bool(rows["visit"].iloc[0])
        side = lambda block, guest: rows[(rows["block"] == block) & (rows["guested"] == guest)]
        x, y = side(left, False), side(right, visit)
        none = pd.DataFrame({"a": [], "n": [], "b": []}, dtype="int64")
        if not len(x) or not len(y):
            return none
        vx, vy = _matrix(x["vec"]), _matrix(y["vec"])
        s = unit(vx) @ unit(vy).T
        hit = s >= threshold - NEAR
        if left == right and not visit:
            hit &= np.triu(np.ones(hit.shape, dtype=bool), 1)
        i, j = np.nonzero(hit)
        close = np.flatnonzero(s[i, j] < threshold + NEAR)
        if len(close):
            keep = np.ones(len(i), dtype=bool)
            for c in range(0, len(close), 65_536):
                at = close[c : c + 65_536]
                keep[at] = cosines(vx[i[at]], vy[j[at]]) >= threshold
            i, j = i[keep], j[keep]
        if visit and len(i):
            # met in the guest's own cell as well if the host visits it: the higher cell of the two counts
            home = y["home"].to_numpy(np.int64)[j]
            low = np.flatnonzero(home > cell)
            if len(low):
                wide = np.int64(MOST_CELLS)
                seen = np.concatenate([np.asarray(g, dtype=np.int64) + r * wide for r, g in enumerate(x["guest"])])
                twice = np.isin(i[low] * wide + home[low], seen)
                keep = np.ones(len(i), dtype=bool)
                keep[low[twice]] = False
                i, j = i[keep], j[keep]
        if not len(i):
            return none
        p = np.concatenate([x["p"].to_numpy(np.int64), y["p"].to_numpy(np.int64)])
        copies = np.concatenate([x["copies"].to_numpy(np.int64), y["copies"].to_numpy(np.int64)])
        j = j + len(x)
        n = np.zeros(len(p), dtype=np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        least = p.copy()
        while True:
            before = least.copy()
            low = np.minimum(least[i], least[j])
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
            if (least == before).all():
                break
        at = np.flatnonzero(n)
        return pd.DataFrame({"a": p[at], "n": n[at], "b": least[at]})

    return block


def link_counts(placed: DataFrame, threshold: float) -> DataFrame:
    """a, n, b of compare() over all blocks. placed: as of assigned()."""
    live = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("rows"))
    visits = placed.select(F.explode("guest").alias("cell")).groupBy("cell").agg(F.count("*").alias("visits"))
    need = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(float(BLOCK)))).cast("int")
    sizes = live.join(visits, "cell", "left").select("cell", need("rows").alias("blocks"), F.ceil(F.coalesce("visits", F.lit(0)) / F.lit(float(BLOCK))).cast("int").alias("visiting"))
    sizes = F.broadcast(written(sizes, "dedup-cells"))  # MOST_CELLS rows at most

    salt = lambda c: F.pmod(F.xxhash64("p"), F.col(c)).cast("int")
    host = placed.join(sizes, placed["home"] == sizes["cell"]).withColumn("block", salt("blocks"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = F.transform(upto("blocks"), lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right"), F.lit(False).alias("visit")))
    met = F.when(F.col("visiting") > 0, F.transform(upto("visiting"), lambda o: F.struct(F.col("block").alias("left"), o.alias("right"), F.lit(True).alias("visit"))))
    hosts = host.select("p", "vec", "copies", "home", "guest", "cell", "block", F.lit(False).alias("guested"), F.explode(F.concat(own, F.coalesce(met, F.array().cast("array<struct<left:int,right:int,visit:boolean>>")))).alias("t"))
    guests = placed.select("p", "vec", "copies", "home", F.explode("guest").alias("to")).join(sizes, F.col("to") == sizes["cell"]).withColumn("block", salt("visiting"))
    guests = guests.select("p", "vec", "copies", "home", F.array().cast("array<int>").alias("guest"), "cell", "block", F.lit(True).alias("guested"), F.explode(F.transform(upto("blocks"), lambda o: F.struct(o.alias("left"), F.col("block").alias("right"), F.lit(True).alias("visit")))).alias("t"))
    tasks = hosts.unionByName(guests).select("p", "vec", "copies", "home", "guest", "cell", "block", "guested", "t.*")
    return tasks.groupBy("cell", "left", "right", "visit").applyInPandas(compare(threshold), "a long, n long, b long")


def sample_links(points: DataFrame, threshold: float) -> dict[int, int]:
    """Of a sample of points, the rows of other points that each is linked with, by one scan over all points."""
    drawn = points.orderBy(F.xxhash64("p", F.lit(2)), "p").limit(SAMPLE).select("p", "vec").collect()
    shared = points.sparkSession.sparkContext.broadcast((np.array([r["p"] for r in drawn], dtype=np.int64), np.array([r["vec"] for r in drawn], dtype=np.float64)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, vecs = shared.value
        q, n = unit(vecs), np.zeros(len(who), dtype=np.int64)
        for b in batches:
            if len(b):
                hit = q @ unit(_matrix(b["vec"])).T >= threshold + NEAR
                hit &= who[:, None] != b["p"].to_numpy(np.int64)[None, :]
                n += hit @ b["copies"].to_numpy(np.int64)
        yield pd.DataFrame({"p": who, "n": n})

    found = points.select("p", "vec", "copies").mapInPandas(scan, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    return {r["p"]: r["n"] for r in found}


def point_links(points: DataFrame, threshold: float, cells: int | None, margin: float | None) -> DataFrame:
    """a, n, b over all blocks, once the sample's links are found. points: p, vec (of one length), copies."""
    spark = points.sparkSession
    n = points.count()
    k = cells or max(1, min(MOST_CELLS, TRAIN_ROWS, round(CELLS_PER_ROOT * math.sqrt(n)), n))
    drawn = points.orderBy(F.xxhash64("p", F.lit(1)), "p").limit(TRAIN_ROWS).select("vec").toPandas()
    centres = spherical_kmeans(unit(_matrix(drawn["vec"])), k)
    safe = math.sqrt(2 - 2 * threshold) / 2 + NEAR
    margin = min(safe, MARGIN_SIGMAS * safe / math.sqrt(centres.shape[1]) if margin is None else margin)
    truth = sample_links(points, threshold)
    while True:
        placed = written(assigned(points, centres, margin), "dedup-cells")
        found = written(link_counts(placed, threshold), "dedup-links")
        remove(spark, placed)
        have = {r["a"]: r["n"] for r in found.filter(F.col("a").isin(list(truth))).groupBy("a").agg(F.sum("n").alias("n")).collect()}
        got, all_ = sum(min(have.get(p, 0), x) for p, x in truth.items()), sum(truth.values())
        if margin >= safe or got >= TARGET * all_:
            return found
        remove(spark, found)
        margin = min(safe, 2 * margin)


def dedup(rows: DataFrame, threshold: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, margin: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    spark = rows.sparkSession
    named = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(F.col(f"`{vec_col}`").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"))  # -0.0 is 0.0
    links = F.col("id").isNotNull() & takes_part(F.col("vec"))
    good = named.filter(links)
    alone = named.filter(~links).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    points = written(points_of(good).withColumn("p", F.col("v")), "dedup-points")
    seen = points.agg(F.count("*").alias("n"), F.countDistinct("p").alias("d")).first()
    if seen["n"] > seen["d"]:  # an id with several vectors: each vector has a number of its own
        points = written(points.withColumn("p", F.xxhash64("vec")), "dedup-points")
    found = None
    for r in points.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect():  # as many as vectors have lengths
        same = point_links(points.filter(F.size("vec") == r["d"]).select("p", "vec", "copies"), threshold, cells, margin)
        found = same if found is None else found.unionByName(same)
    if found is None:
        return alone
    counts = found.groupBy(F.col("a").alias("p")).agg(F.sum("n").alias("n"))
    labels = components(found.select("a", "b")).select(F.col("node").alias("p"), "label")
    told = points.join(counts, "p", "left").join(labels, "p", "left").select("vec", "v", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("label", "p").alias("label"))
    least = told.groupBy("label").agg(F.min("v").alias("component"))
    told = told.join(least, "label").select("vec", (F.col("n") + F.col("copies") - 1).alias("n"), "component")
    linked = good.join(told, "vec").select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    return linked.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(alone)
