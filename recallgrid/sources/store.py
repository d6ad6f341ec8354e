"""A package store of Parquet tables: packages and package_versions. Vectors have a table of their own (vectors.py).

Rows of a version live in their own folder, name=NAME/version=N, written by Spark's commit protocol, so
saving a version again replaces that folder and nothing else; readers prune by both keys.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import estimate_tokens, item_id

ITEMS = "category string, pos int, id string, content string, confidence double, source string, origin string, redactions array<struct<kind:string,count:int>>"
INFO = "schema_version int, source_model string, item_count long, created_at timestamp, updated_at timestamp, note string, metadata string"


class NotFound(KeyError):
    pass


class InvalidName(ValueError):
    pass


def check_name(name: str | None) -> str:
    import re

    cleaned = (name or "").strip()
    if not re.match(C.PACKAGE_NAME, cleaned) or ".." in cleaned:
        raise InvalidName(f"not a package name: {name!r}")
    return cleaned


class ParquetStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, kind: str, name: str = "", version: int | None = None) -> str:
        return f"{self.base}/{kind}" + (f"/name={name}" if name else "") + (f"/version={version}" if version is not None else "")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _children(self, path: str, prefix: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName().removeprefix(prefix) for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)) if fs.exists(p) else []

    def exists(self, name: str) -> bool:
        try:
            return bool(self.list_versions(check_name(name)))
        except InvalidName:
            return False

    def list_packages(self) -> list[str]:
        return self._children(self._path("versions"), "name=")

    def list_versions(self, name: str) -> list[int]:
        return sorted(map(int, self._children(self._path("versions", name), "version=")))

    def save(self, name: str, version: int, items: DataFrame, source_model: str = "", note: str = "", metadata: dict | None = None) -> None:
        name = check_name(name)
        now = datetime.now(timezone.utc)
        old = self.info(name).select("created_at").orderBy("version").first() if self.exists(name) else None
        rows = items.select(*[c.split()[0] for c in ITEMS.split(", ")[:7]], "redactions").persist()
        rows.write.mode("overwrite").parquet(self._path("items", name, version))
        info = [(C.SCHEMA_VERSION, source_model, rows.count(), old[0] if old else now, now, note, json.dumps(metadata or {}))]
        rows.unpersist()
        self.spark.createDataFrame(info, INFO).coalesce(1).write.mode("overwrite").parquet(self._path("versions", name, version))

    def info(self, name: str) -> DataFrame:
        return self.spark.read.schema(INFO + ", version int").option("basePath", self._path("versions", name)).parquet(self._path("versions", name))

    def load(self, name: str, version: int | None = None) -> DataFrame:
        versions = self.list_versions(check_name(name))
        version = version if version is not None else max(versions, default=None)
        if version not in versions:
            raise NotFound(f"{name} v{version}")
        fs, p = self._fs(self._path("items", name, version))
        if not fs.exists(p):  # imported without an item
            return self.spark.createDataFrame([], ITEMS)
        return self.spark.read.schema(ITEMS).parquet(self._path("items", name, version))

    def delete(self, name: str) -> None:
        for kind in ("items", "versions"):
            fs, p = self._fs(self._path(kind, name))
            fs.delete(p, True)

    def delete_version(self, name: str, version: int) -> None:
        """The entry goes first, so that no listed version lacks its items."""
        for kind in ("versions", "items"):
            fs, p = self._fs(self._path(kind, name, version))
            fs.delete(p, True)

    def summaries(self) -> DataFrame:
        """A row per package, of its latest version; items are not read."""
        if not self.list_packages():
            return self.spark.createDataFrame([], f"name string, version int, {INFO}")
        rows = self.spark.read.schema(INFO + ", name string, version int").parquet(self._path("versions"))
        cols = [c.split()[0] for c in INFO.split(", ")]
        return rows.groupBy("name").agg(F.max("version").alias("version"), F.max_by(F.struct(*cols), "version").alias("x")).select("name", "version", "x.*").orderBy("name")

    def stats(self) -> dict[str, int]:
        names = self.list_packages()
        return {"packages": len(names), "versions": sum(len(self.list_versions(n)) for n in names)}

    def export(self, name: str) -> str:
        """The envelope of a package as JSON; a package is bounded by MAX_IMPORT_BYTES."""
        items = [r.asDict(True) for r in self.load(name).orderBy("category", "pos").collect()]
        info = self.info(name).orderBy(F.desc("version")).first().asDict()
        package = {"name": name, "version": info["version"], "source_model": info["source_model"], "memory": {c: [i for i in items if i["category"] == c] for c in C.CATEGORIES}}
        return json.dumps({"format": C.ENVELOPE_FORMAT, "schema_version": C.SCHEMA_VERSION, "exported_at": datetime.now(timezone.utc).isoformat(), "package": package}, indent=2, ensure_ascii=False)

    def import_data(self, data: str, rename: str | None = None, overwrite: bool = False) -> str:
        """Save an envelope or a bare package; an existing name is refused unless overwritten."""
        if len(data.encode("utf-8")) > C.MAX_IMPORT_BYTES:
            raise ValueError("package document is too large")
        try:
            doc = json.loads(data)
        except json.JSONDecodeError as e:
            raise ValueError("not a JSON document") from e
        package = doc.get("package", doc) if isinstance(doc, dict) else None
        if not isinstance(package, dict) or not package.get("name") or not isinstance(package.get("memory"), dict):
            raise ValueError("not a package document")
        name = check_name(rename or package["name"])
        if self.exists(name) and not overwrite:
            raise ValueError(f"package {name} exists")
        rows = [(c, i, x.get("id"), x["content"], float(x.get("confidence", 1.0)), x.get("source", ""), x.get("origin", ""), [(r["kind"], r["count"]) for r in x.get("redactions", [])]) for c in C.CATEGORIES for i, x in enumerate(package["memory"].get(c, []))]
        items = self.spark.createDataFrame(rows, ITEMS).withColumn("id", F.coalesce(F.nullif("id", F.lit("")), item_id(F.col("category"), F.col("content"))))
        self.save(name, int(package.get("version", 1)), items, package.get("source_model", ""), "imported")
        return name


def described(items: DataFrame) -> DataFrame:
    """Items as shown to callers, with a token estimate each."""
    return items.withColumns({"tokens": estimate_tokens(F.col("content")), "was_redacted": F.size("redactions") > 0})
