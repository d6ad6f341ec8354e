"""A watched folder as a stream: of new text files the users' sentences are extracted, and new items make a new version.

Repeats are dropped twice. Within the watermark's delay the stream's own state drops them (the event time is the time
of arrival, so no file is late to the watermark, and the state is bounded by what came within the delay); older ones
are dropped against the package, when a batch is appended to it.

A file source passes over files that are older than the newest one by its maximal age, and remembers the names of all
younger ones. The age is ten years here, so that files moved in with an old date are read; where a folder takes files
without end, archive what was read or set a smaller age.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import clean, item_id
from ..operators import package as P
from ..operators.extract import candidate_sentences, rules
from ..operators.redact import redact_items
from ..shared import remove, written
from ..sources.store import ITEMS, ParquetStore

#: How much older than the newest a file may be.
FILE_AGE = "3650d"
NO_REDACTIONS = "array<struct<kind:string,count:int>>"


def watch(spark: SparkSession, folder: str, package: str, delay: str = "1 hour", files_per_batch: int = 1000, file_age: str = FILE_AGE) -> DataFrame:
    """Streaming items of the files that appear under a folder: package, category, id, content, confidence, source, origin, spot (file and sentence)."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", file_age).load(folder)
    files = files.select(F.col("_metadata.file_path").alias("file"), "value", F.current_timestamp().alias("arrived")).withWatermark("arrived", delay)
    said = files.select("file", "arrived", F.posexplode(candidate_sentences(F.col("value"))).alias("nth", "sentence"))
    fired = F.filter(F.array(*[F.when(on, F.lit(c)) for c, on in rules(F.col("sentence")).items()]), lambda x: x.isNotNull())
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("category")]
    items = said.select(F.lit(package).alias("package"), F.explode(fired).alias("category"), clean(F.col("sentence")).alias("content"), F.col("file").alias("origin"), F.struct("file", "nth").alias("spot"), "arrived")
    items = items.withColumns({"id": item_id(F.col("category"), F.col("content")), "confidence": table(C.CONFIDENCE), "source": table(C.RULE_TAGS)})
    return items.dropDuplicatesWithinWatermark(["package", "id"])


def append_to(items: DataFrame, path: str, checkpoint: str):
    """Start writing the stream's items to a folder; each is written once."""
    return items.drop("spot").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_batch(store: ParquetStore, package: str, stream: str, batch: DataFrame, number: int, redacted: bool = True) -> int | None:
    """Append a batch's new items as the package's next version; None where there is nothing new or the batch was appended before.

    A version tells the stream and the batch that made it, so a batch that is given again after a failure changes nothing.
    """
    versions = store.list_versions(package)
    if versions:
        for r in store.info(package).select("metadata").filter(F.col("metadata").contains('"stream"')).toLocalIterator():
            made = json.loads(r["metadata"])
            if made.get("stream") == stream and made.get("batch") == number:
                return None
    items = batch.drop("package", "arrived").withColumn("redactions", F.array().cast(NO_REDACTIONS)).withColumn("pos", F.col("spot"))
    items = redact_items(items, None, redacted)
    held = store.load(package) if versions else batch.sparkSession.createDataFrame([], ITEMS)
    names = [c.split()[0] for c in ITEMS.split(", ")[:7]] + ["redactions"]
    grown = written(P.append_new(held, items.select(*names), ["category"]), "watched")
    version = None
    if grown.count() > held.count():
        version = max(versions, default=0) + 1
        store.save(package, version, grown, "rules", "watched", {"stream": stream, "batch": number})
    remove(batch.sparkSession, grown)
    return version


def watch_into(store: ParquetStore, folder: str, package: str, checkpoint: str, delay: str = "1 hour", files_per_batch: int = 1000, redacted: bool = True):
    """Start a stream that appends a folder's new items to a package, a version per batch; the checkpoint's path names the stream."""
    items = watch(store.spark, folder, package, delay, files_per_batch)
    each = lambda batch, number: append_batch(store, package, checkpoint, batch, number, redacted)
    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
