"""Multidimensional clustered layout, cell first.

Each row gets a coordinate per key, its share of the rows with a smaller key in LEVELS steps, and the coordinates'
bits interleave to a cell z. Cells are few (at most 2**MOST_CELL_BITS), however many rows there are. Rows are never
sorted as a whole: a histogram over (cell, range of ids) is summed up to the offset of each piece, rows are ranked
inside their piece alone, and everything about files follows from the intervals of positions that cells take.
Inner files of a cell hold nothing but that cell, so bounds, files touched and files matching are worked out on
the table of cells without looking at rows again.

Coordinates are exact: a row has coordinate k or more when its key is over the ceil(k * n / LEVELS)-th smallest one.
These LEVELS - 1 keys are found by counting distinct keys in ranges, summing the ranges up, and then running sums
within each range, so the values of a key may be as many as rows.

Edge cases: a null key is the smallest, a null id comes first in its cell; rows with equal keys and ids stand in any order among
themselves; an empty table gives an empty result; columns of other names don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Bits of a coordinate, and the most bits of a cell, which bound every table of cells.
BITS, MOST_CELL_BITS = 3, 16
#: Ranges of ids: the rows of a cell are ranked in so many pieces. Ranges of key values that are summed up apart.
ID_RANGES, VALUE_RANGES = 1024, 256
FILE_ROWS = 1000


def text_key(c: Column) -> Column:
    """A string that orders texts by their UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), c), F.lit("0"))


def number_key(c: Column) -> Column:
    """A string that orders whole numbers from -1 on, null first."""
    return F.coalesce(F.lpad((c.cast("long") + 1).cast("string"), 20, "0"), F.lit(""))


def quantile_keys(narrow: DataFrame, names: list[str], n: int) -> list[list[str]]:
    """Per key the ceil(k * n / LEVELS)-th smallest value over the rows, k from 1 to LEVELS - 1."""
    levels = 1 << BITS
    wanted = [-(-k * n // levels) for k in range(1, levels)]
    values = narrow.select(F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).alias("key")) for i, c in enumerate(names)])).alias("x")).groupBy("x.dim", "x.key").agg(F.count("*").alias("rows"))
    values = written(values.repartitionByRange(VALUE_RANGES, "dim", "key").withColumn("range", F.spark_partition_id()), "layout-values")
    sums = values.groupBy("dim", "range").agg(F.sum("rows").alias("all"))  # VALUE_RANGES + len(names) rows at most
    base = sums.withColumn("before", F.sum("all").over(Window.partitionBy("dim").orderBy("range")) - F.col("all")).drop("all")
    upto = F.sum("rows").over(Window.partitionBy("dim", "range").orderBy("key")) + F.col("before")
    told = values.join(base.hint("merge"), ["dim", "range"]).withColumn("upto", upto)
    holds = F.exists(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: (w <= F.col("upto")) & (w > F.col("upto") - F.col("rows")))
    found = told.filter(holds).select("dim", "key", "upto").collect()  # LEVELS - 1 rows a key at most
    out = []
    for i in range(len(names)):
        mine = sorted((r["upto"], r["key"]) for r in found if r["dim"] == i)
        out.append([next(key for upto, key in mine if w <= upto) for w in wanted])
    return out


def interleaved(coords: list[Column]) -> Column:
    """The coordinates' bits, highest first, each round in the order given."""
    bits = [(F.shiftright(c, b).bitwiseAND(1), (BITS - 1 - b) * len(coords) + i) for i, c in enumerate(coords) for b in range(BITS)]
    last = BITS * len(coords) - 1
    return reduce(lambda x, y: x + y, [F.shiftleft(bit.cast("long"), last - place) for bit, place in bits])


def coordinate(z: Column, dim: int, dims: int) -> Column:
    last = BITS * dims - 1
    return reduce(lambda x, y: x + y, [F.shiftleft(F.shiftright(z, last - ((BITS - 1 - b) * dims + dim)).bitwiseAND(1), b) for b in range(BITS)]).cast("int")


def cell_table(cells: DataFrame, reach: list[int], file_rows: int) -> DataFrame:
    """Per cell (z, rows): its first position, first and last file, their bounds and its own, files touched and matching.

    A query asks for coordinates at most `reach` away from a row's own. It touches the files whose bounds meet that, and
    matches those that hold a row there. Every table here has at most as many rows as there are cells, or boxes times cells.
    """
    dims, top = len(reach), (1 << BITS) - 1
    cs = [f"c{i}" for i in range(dims)]
    off = F.sum("rows").over(Window.orderBy("z")) - F.col("rows")  # as many rows as cells: 2**MOST_CELL_BITS at most
    cells = cells.withColumn("start", off).select("z", "rows", "start", F.expr(f"start div {file_rows}").alias("first"), F.expr(f"(start + rows - 1) div {file_rows}").alias("last"), *[coordinate(F.col("z"), i, dims).alias(c) for i, c in enumerate(cs)])
    cells = written(cells, "layout-cells")

    shared = cells.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("file"), *cs).groupBy("file")
    shared = written(shared.agg(*[f(c).alias(f"{n}_{c}") for c in cs for n, f in (("low", F.min), ("high", F.max))]), "layout-shared-files")
    inner = cells.filter("last - first > 1").select((F.col("last") - F.col("first") - 1).alias("files"), *[F.col(c).alias(f"{n}_{c}") for c in cs for n in ("low", "high")])
    boxes = shared.drop("file").withColumn("files", F.lit(1).cast("long")).unionByName(inner).groupBy(*[f"{n}_{c}" for c in cs for n in ("low", "high")]).agg(F.sum("files").alias("files"))
    for c, r in zip(cs, reach):
        boxes = boxes.withColumn(c, F.explode(F.sequence(F.greatest(F.lit(0), F.col(f"low_{c}") - r), F.least(F.lit(top), F.col(f"high_{c}") + r)))).drop(f"low_{c}", f"high_{c}")
    touched = boxes.groupBy(interleaved([F.col(c) for c in cs]).alias("z")).agg(F.sum("files").alias("touched"))

    near = cells.select(F.col("z").alias("asker"), *cs)
    for c, r in zip(cs, reach):
        if r:
            near = near.withColumn(c, F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - r), F.least(F.lit(top), F.col(c) + r))))
    near = near.select("asker", interleaved([F.col(c) for c in cs]).alias("z")).join(cells.select("z", "first", "last").hint("merge"), "z")
    # files of cells in the order of z: only the last file of one and the first of the next can be the same
    seen = F.coalesce(F.lag("last").over(Window.partitionBy("asker").orderBy("z")), F.lit(-1))
    new = near.withColumn("new", F.col("last") - F.greatest(F.col("first"), seen + 1) + 1)
    matching = new.groupBy(F.col("asker").alias("z")).agg(F.sum("new").alias("matching"))

    bounds = F.concat_ws(",", *[f"{n}_{c}" for c in cs for n in ("low", "high")])
    at = lambda name: shared.select(F.col("file").alias(name), bounds.alias(f"{name}_bounds")).hint("merge")
    own = F.concat_ws(",", *[c for c in cs for _ in range(2)])
    return cells.join(at("first"), "first").join(at("last"), "last").join(touched.hint("merge"), "z").join(matching.hint("merge"), "z").select("z", "rows", "start", "first", "last", "first_bounds", "last_bounds", own.alias("own_bounds"), "touched", "matching")


def lay_out(rows: DataFrame, id_col: str, keys: list[Column], reach: list[int], file_rows: int = FILE_ROWS, id_ranges: int = ID_RANGES) -> DataFrame:
    """id, z, position, file, files_touched, files_matching, file_bounds of every row. keys: as of text_key and number_key."""
    dims = len(keys)
    if BITS * dims > MOST_CELL_BITS or len(reach) != dims:
        raise ValueError(f"at most {MOST_CELL_BITS // BITS} keys, each with its reach")
    names = [f"k{i}" for i in range(dims)]
    narrow = written(rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), *[k.alias(c) for k, c in zip(keys, names)]), "layout-keys")
    cuts = [i / id_ranges for i in range(1, id_ranges)]
    seen = narrow.agg(F.count("*").alias("n"), F.percentile_approx("id", cuts, 8 * id_ranges).alias("cuts")).first()
    marks = quantile_keys(narrow, names, seen["n"]) if seen["n"] else [[] for _ in names]
    coords = [reduce(lambda x, y: x + y, [(F.col(c) > m).cast("int") for m in ms], F.lit(0)) for c, ms in zip(names, marks)]
    edges = sorted({float(x) for x in seen["cuts"] or []}) or [0.0]
    placed = narrow.select("id", F.coalesce(F.col("id").cast("double"), F.lit(float("-inf"))).alias("_at"), interleaved(coords).alias("z"))
    placed = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_at", outputCol="_block").transform(placed).select("id", "z", F.col("_block").cast("int").alias("block"))

    pieces = written(placed.groupBy("z", "block").agg(F.count("*").alias("rows")), "layout-pieces")
    cells = cell_table(pieces.groupBy("z").agg(F.sum("rows").alias("rows")), reach, file_rows)
    before = F.sum("rows").over(Window.partitionBy("z").orderBy("block")) - F.col("rows")
    pieces = pieces.withColumn("before", before).drop("rows").join(cells.drop("rows").hint("merge"), "z").withColumn("offset", F.col("start") + F.col("before")).drop("start", "before")

    rank = F.row_number().over(Window.partitionBy("z", "block").orderBy(F.col("id").asc_nulls_first()))
    out = placed.join(pieces.hint("merge"), ["z", "block"]).withColumn("position", F.col("offset") + rank - 1).withColumn("file", F.expr(f"position div {file_rows}"))
    bounds = F.when(F.col("file") == F.col("first"), F.col("first_bounds")).when(F.col("file") == F.col("last"), F.col("last_bounds")).otherwise(F.col("own_bounds"))
    return out.select("id", "z", "position", "file", F.col("touched").alias("files_touched"), F.col("matching").alias("files_matching"), bounds.alias("file_bounds"))


def document_layout(docs: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """Documents by source, lang, length in bytes (null text: -1) and a date (CRC-32 of the id, modulo 365)."""
    length = F.coalesce(F.octet_length("text"), F.lit(-1))
    date = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 365
    keys = [text_key(F.col("source")), text_key(F.col("lang")), number_key(length), number_key(date)]
    return lay_out(docs, "doc_id", keys, [0, 0, 1, 1], file_rows).withColumnRenamed("id", "doc_id")
