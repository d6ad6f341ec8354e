"""Streams into a package: repeats, assistants' turns, batches given again."""

import os
import time

from recallgrid.sources.store import ParquetStore
from recallgrid.streaming.watch import append_batch, watch, watch_into

FIRST = "User: We decided to use Postgres for storage.\n\nAssistant: We decided to use MySQL for caching.\n\nUser: We decided to use Postgres for storage."
AGAIN = "User: we decided to  use Postgres for storage.\n\nUser: I prefer tabs over spaces. Write to a.b@example.com, I prefer mail."


def put(folder, name, text, age=0):
    (folder / name).write_text(text)
    if age:
        os.utime(folder / name, (time.time() - age,) * 2)


def run(stream):
    stream.awaitTermination()
    return stream.exception()


def test_two_batches_with_repeats(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = ParquetStore(spark, f"file://{tmp_path}/store")
    start = lambda: watch_into(store, f"file://{folder}", "p", f"file://{tmp_path}/cp", files_per_batch=1)
    put(folder, "a.txt", FIRST)
    assert run(start()) is None
    one = store.load("p").collect()
    assert store.list_versions("p") == [1] and {r["category"] for r in one} >= {"decisions"}
    assert all("MySQL" not in r["content"] for r in one) and len({(r["category"], r["content"]) for r in one}) == len(one)

    put(folder, "b.txt", AGAIN, age=10**7)  # an old file that comes late
    put(folder, "c.txt", FIRST)  # nothing new: no version
    assert run(start()) is None
    two = store.load("p").collect()
    assert store.list_versions("p") == [1, 2]
    assert {r["id"] for r in one} < {r["id"] for r in two}
    assert sum("Postgres" in r["content"] for r in two) == sum("Postgres" in r["content"] for r in one)
    mail = [r for r in two if "I prefer mail" in r["content"]]
    assert mail and all("a.b@example.com" not in r["content"] and r["redactions"] for r in mail)
    for c in {r["category"] for r in two}:
        assert sorted(r["pos"] for r in two if r["category"] == c) == list(range(sum(r["category"] == c for r in two)))


def test_batch_given_again(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/store")
    rows = [("p", "facts", "Water boils at 100 degrees.", "f", ("f", 0), "i1", 0.5, "rule")]
    batch = spark.createDataFrame(rows, "package string, category string, content string, origin string, spot struct<file:string,nth:int>, id string, confidence double, source string")
    assert append_batch(store, "p", "s", batch, 0) == 1
    assert append_batch(store, "p", "s", batch, 0) is None and store.list_versions("p") == [1]
    assert append_batch(store, "p", "s", batch, 1) is None and store.load("p").count() == 1
    assert append_batch(store, "q", "s", batch.limit(0), 0) is None and store.list_versions("q") == []


def test_stream_needs_a_folder_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert watch(spark, f"file://{tmp_path}/in", "p").isStreaming
