"""Many package documents at once: JSON files of a folder, enveloped or bare, read permissively and written as versions.

A file that can't be used gives a row with its problem and no items (a file of no bytes none, as scans pass over it); no
file fails the others. Problems, in the order
in which they are looked for:
- too large (over MAX_IMPORT_BYTES; not parsed), not JSON, not a package (no name, no memory), not a name (package names);
- no content (an item without one), not a version (under 1);
- after the current one: a file named latest.json tells its package's current version, as left by a rollback; later
  ones are not current in a store whose rollback removes what comes later, so they are not imported;
- repeated: another file holds this version. latest.json comes first, then the smaller path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import item_id, package_name_ok, strip
from ..shared import remove, written
from .store import INFO, ITEMS, ParquetStore

_ITEM = "struct<id:string,content:string,confidence:double,source:string,origin:string,redactions:array<struct<kind:string,count:int>>>"
_PACKAGE = f"name:string,version:int,source_model:string,metadata:string,memory:struct<{','.join(f'{c}:array<{_ITEM}>' for c in C.CATEGORIES)}>"
DOCUMENT = f"struct<package:struct<{_PACKAGE}>,{_PACKAGE}>"
CURRENT = "latest.json"


def parse_packages(files: DataFrame, path: str = "path", raw: str = "raw", limit: int = C.MAX_IMPORT_BYTES) -> DataFrame:
    """path, name, version, source_model, metadata, memory, problem of each document. Names are stripped; a version that is missing is 1."""
    size = F.octet_length(F.col(raw))
    text = F.when(size <= limit, F.col(raw))
    base = files.select(F.col(path).alias("path"), (size > limit).alias("large"), F.try_parse_json(text).isNotNull().alias("json"), F.from_json(text, DOCUMENT).alias("d"))
    base = base.withColumn("p", F.when(F.col("d.package").isNotNull(), F.col("d.package")).otherwise(F.struct(*[F.col(f"d.{f}").alias(f) for f in ("name", "version", "source_model", "metadata", "memory")])))
    rows = base.select("path", "large", "json", strip(F.col("p.name")).alias("name"), F.coalesce("p.version", F.lit(1)).alias("version"), F.coalesce("p.source_model", F.lit("")).alias("source_model"), F.coalesce("p.metadata", F.lit("{}")).alias("metadata"), F.col("p.memory").alias("memory"))
    void = F.lit(False)
    for c in C.CATEGORIES:
        void = void | F.coalesce(F.exists(f"memory.{c}", lambda x: x["content"].isNull()), F.lit(False))
    problem = F.when(F.coalesce("large", F.lit(False)), "too large").when(~F.col("json"), "not JSON").when(F.coalesce("name", F.lit("")).eqNullSafe("") | F.col("memory").isNull(), "not a package")
    problem = problem.when(~package_name_ok(F.col("name")), "not a name").when(void, "no content").when(F.col("version") < 1, "not a version")
    rows = rows.withColumn("problem", problem).drop("large", "json").withColumn("latest", F.element_at(F.split("path", "/"), -1) == CURRENT)

    fine = F.col("problem").isNull()
    now = F.max(F.when(fine & F.col("latest"), F.col("version"))).over(Window.partitionBy("name"))
    rows = rows.withColumn("problem", F.when(fine & (F.col("version") > now), "after the current one").otherwise(F.col("problem")))
    place = F.row_number().over(Window.partitionBy("name", "version", F.col("problem").isNull()).orderBy(F.desc("latest"), "path"))
    return rows.withColumn("problem", F.when(fine & (place > 1), "repeated").otherwise(F.col("problem"))).drop("latest")


def package_items(packages: DataFrame) -> DataFrame:
    """Items of the documents without a problem: name, version and the columns of a stored item; a missing id is made from the content."""
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"memory.{c}").alias("xs")) for c in C.CATEGORIES])
    rows = packages.filter("problem is null").select("name", "version", F.explode(each).alias("m")).select("name", "version", "m.category", F.posexplode("m.xs").alias("pos", "x")).filter("x is not null")
    blank = lambda f: F.coalesce(F.col(f"x.{f}"), F.lit("")).alias(f)
    own = F.coalesce(F.nullif("x.id", F.lit("")), item_id(F.col("category"), F.col("x.content"))).alias("id")
    none = F.array().cast("array<struct<kind:string,count:int>>")
    return rows.select("name", "version", "category", "pos", own, F.col("x.content").alias("content"), F.coalesce("x.confidence", F.lit(1.0)).alias("confidence"), blank("source"), blank("origin"), F.coalesce("x.redactions", none).alias("redactions"))


def read_packages(spark: SparkSession, path: str, limit: int = C.MAX_IMPORT_BYTES) -> DataFrame:
    """The documents of a folder's JSON files, as parse_packages gives them; nothing is saved."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    return parse_packages(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")), limit=limit)


def import_folder(store: ParquetStore, path: str, limit: int = C.MAX_IMPORT_BYTES) -> DataFrame:
    """Import all packages of a folder that the store lacks, with all their versions; returns path, name, version, problem of each file.

    Names that the store holds stay as they are (problem: exists). Items are written first, and a version is there once
    its entry is, so an import that fails on the way can be given again.
    """
    spark = store.spark
    found = read_packages(spark, path, limit)
    held = store.summaries().select("name", F.lit(True).alias("held"))
    found = found.join(held, "name", "left").withColumn("problem", F.when(F.col("problem").isNull() & F.col("held"), "exists").otherwise(F.col("problem"))).drop("held")
    found = written(found, "import")
    items = written(package_items(found), "import-items")

    def save(rows: DataFrame, kind: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name", "version").parquet(f"{store.base}/{kind}")

    names = [c.split()[0] for c in ITEMS.split(", ")[:7]] + ["redactions"]
    save(items.select("name", "version", *names).repartition("name", "version", "category"), "items")
    sizes = items.groupBy("name", "version").agg(F.count("*").alias("item_count"))
    info = found.filter("problem is null").join(sizes, ["name", "version"], "left").fillna(0, ["item_count"])
    info = info.withColumns({"schema_version": F.lit(C.SCHEMA_VERSION), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "note": F.lit("imported")})
    save(info.select("name", "version", *[c.split()[0] for c in INFO.split(", ")]).repartition("name", "version"), "versions")
    remove(spark, items)
    return found.select("path", "name", "version", "problem")
