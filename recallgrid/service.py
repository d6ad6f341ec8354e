"""The operations a user calls: import, retrieve, prompt, history, merge, export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .functions.text import estimate_tokens
from .operators import merge as M
from .operators import package as P
from .operators import prompt, redact
from .operators.extract import extract, parse_replies
from .operators.retrieve import RetrievalOptions, assemble
from .shared import remove, written
from .sources.store import ITEMS, NotFound, ParquetStore, check_name


@dataclass
class Settings:
    redact_by_default: bool = True
    max_text_chars: int = C.MAX_TEXT_CHARS
    #: Model engines by name: text -> JSON reply.
    engines: dict[str, Callable[[str], str]] = field(default_factory=dict)


class Service:
    def __init__(self, spark: SparkSession, base: str, settings: Settings | None = None):
        self.spark, self.store, self.settings = spark, ParquetStore(spark, base), settings or Settings()

    def extract(self, text: str, engine: str = "local", origin: str = "") -> DataFrame:
        if engine in ("local", "rules", "offline", "none", ""):
            one = self.spark.createDataFrame([(0, text)], "k int, t string")
            items = extract(one, "k", "t", F.lit(origin))
        elif engine in self.settings.engines:
            reply = self.spark.createDataFrame([(0, self.settings.engines[engine](text))], "k int, t string")
            items = parse_replies(reply, "k", "t", origin)
        else:
            raise ValueError(f"unknown engine {engine!r}")
        return items.drop("key").withColumn("redactions", F.array().cast("array<struct<kind:string,count:int>>"))

    def import_text(self, text: str, package: str, engine: str = "local", origin: str = "", redacted: bool | None = None, kinds=None, mode: str = "append") -> DataFrame:
        """Extract, mask and save as a new version; returns the package's items."""
        name = check_name(package)
        if mode not in ("append", "replace"):
            raise ValueError("mode is append or replace")
        if not text.strip() or len(text) > self.settings.max_text_chars:
            raise ValueError("text is empty or too large")
        on = self.settings.redact_by_default if redacted is None else redacted
        items = redact.redact_items(self.extract(text, engine, origin), kinds, on).select(*[c.split()[0] for c in ITEMS.split(", ")[:7]], "redactions")
        versions = self.store.list_versions(name)
        if versions and mode == "append":
            items = P.append_new(self.store.load(name), items, ["category"])
        self.store.save(name, max(versions, default=0) + 1, items, engine, "created" if not versions else mode)
        return self.store.load(name)

    def scan(self, text: str) -> DataFrame:
        return redact.report(self.spark.createDataFrame([(text,)], "t string"), "t")

    def history(self, name: str) -> DataFrame:
        versions = self.store.info(name)
        log, before = None, None
        for v in self.store.list_versions(name):
            now = self.store.load(name, v)
            part = (P.diff(before, now, []) if before is not None else now.withColumn("op", F.lit("added"))).select("op", "id").withColumn("version", F.lit(v))
            log, before = part if log is None else log.unionByName(part), now
        return P.version_summary(versions.select("version", "updated_at", "source_model", "note"), log)

    def remove_items(self, name: str, ids: list[str]) -> DataFrame:
        wanted = [i for i in ids if isinstance(i, str) and i]
        if not wanted:
            raise ValueError("no item ids")
        stay, _ = P.remove_items(self.store.load(name), self.spark.createDataFrame([(i,) for i in wanted], "id string"))
        self.store.save(name, max(self.store.list_versions(name)) + 1, stay, note="removed during review")
        return self.store.load(name)

    def rollback(self, name: str, version: int) -> DataFrame:
        versions = self.store.list_versions(name)
        if version not in versions or version >= max(versions):
            raise ValueError("target version must lie before the current one")
        log = None
        for a, b in zip(versions, versions[1:]):
            part = P.diff(self.store.load(name, a), self.store.load(name, b), []).withColumn("version", F.lit(b))
            log = part if log is None else log.unionByName(part)
        items = P.undo(self.store.load(name), log, max(versions), version)
        staged = written(items, "rollback")
        self.store.save(name, version, staged, note=f"rolled back to v{version}")
        for v in versions:  # the newest goes last: until then it stays current, whatever fails
            if v > version:
                self.store.delete_version(name, v)
        remove(self.spark, staged)
        return self.store.load(name)

    def retrieve(self, name: str, query: str, options: RetrievalOptions = RetrievalOptions(), embeddings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        return assemble(self.store.load(name), query, options, embeddings)

    def build_prompt(self, name: str, model: str, query: str | None = None, options: RetrievalOptions = RetrievalOptions(), extras=()) -> dict:
        items = self.store.load(name)
        info = self.store.info(name).orderBy(F.desc("version")).first()
        note, chosen = "", None
        if query:
            chosen, _ = assemble(items, query, options)
            chosen = items.join(chosen.select("id"), "id", "left_semi")
            note = f"Selected by lexical retrieval for: {query!r}"
        block = prompt.build(items, model, name, info["version"], info["source_model"], selected=chosen, note=note)
        if not block:
            raise ValueError("nothing to include")
        text = prompt.paste_prompt(block, extras)
        est = self.spark.createDataFrame([(text,)], "t string").select(estimate_tokens(F.col("t"))).first()[0]
        return {"prompt": text, "block": block, "tokens": est, "target": prompt.display_name(model)}

    def merge_packages(self, names: list[str], new_name: str, dry_run: bool = False, overwrite: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        if len(names) < 2:
            raise ValueError("at least two packages are merged")
        if self.store.exists(new_name) and not (overwrite or dry_run):
            raise ValueError(f"package {new_name} exists")
        pool = None
        for i, n in enumerate(names):
            items = self.store.load(n).withColumns({"origin": F.when(F.col("origin") == "", n).otherwise(F.col("origin")), "pos": F.col("pos").cast("long") + F.lit(i << 40)})
            pool = items if pool is None else pool.unionByName(items)
        final, groups, found = M.merge(pool)
        if not dry_run:
            self.store.save(new_name, 1, final.withColumn("pos", F.col("rk") - 1), "merged", "merged")
        return final, groups, found

    def delete_package(self, name: str) -> None:
        if not self.store.exists(name):
            raise NotFound(name)
        self.store.delete(name)
