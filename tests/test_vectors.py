"""The vector table: upserts, removals, failed writes, folds, and one row an item in retrieval."""

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import retrieve
from recallgrid.sources.vectors import VectorTable

SHAPE = "id string, vector array<double>, seq int"


def rows(spark, *data):
    return spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(data)], SHAPE)


def held(table):
    return {r["id"]: r["vector"] for r in table.load().collect()}


def test_last_write_wins(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    t = VectorTable(spark, path, 2)
    assert held(t) == {} and t.nearest([1.0, 0.0]).collect() == []
    t.save(rows(spark, ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])))
    t.save(rows(spark, ("b", [5.0, 5.0]), ("b", [0.0, 2.0]), ("c", None)), order=F.col("seq"))
    want = {"a": [1.0, 0.0], "b": [0.0, 2.0]}
    assert held(t) == want
    t.compact()
    assert held(t) == want and len(t._live()) == 1
    again = VectorTable(spark, path, 2)
    again.save(rows(spark, ("c", [3.0, 0.0])))
    assert held(again) == want | {"c": [3.0, 0.0]}
    assert [r["id"] for r in again.nearest([1.0, 0.0], 2).collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        VectorTable(spark, path, 3)
    with pytest.raises(ValueError):
        again.nearest([1.0])


@pytest.mark.parametrize("bad", [("x", [1.0]), ("x", [1.0, float("nan")]), ("x", [1.0, None]), (None, [1.0, 2.0])])
def test_a_failed_write_changes_nothing(spark, tmp_path, bad):
    t = VectorTable(spark, f"file://{tmp_path}/v", 2)
    t.save(rows(spark, ("a", [1.0, 0.0])))
    with pytest.raises(Exception, match="a vector has"):
        t.save(rows(spark, ("a", [9.0, 9.0]), bad))
    assert held(t) == {"a": [1.0, 0.0]}


def test_an_item_is_selected_once(spark):
    items = spark.createDataFrame([("i", "facts", "ships sail", 0.9, "")], "id string, category string, content string, confidence double, source string")
    twice = spark.createDataFrame([("i", 0.2), ("i", 0.8)], "id string, cosine double")
    chosen, summary = retrieve.assemble(items, "ships", embeddings=twice)
    assert [(r["id"], r["embedding_score"]) for r in chosen.collect()] == [("i", 0.8)] and summary.first()["considered"] == 1
