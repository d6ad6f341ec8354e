"""Workers that make an index get small batches of texts and hold postings, not words."""

from pyspark.sql import functions as F

from recallgrid.operators import index


def test_index_is_made_from_small_batches(spark, monkeypatch, tmp_path):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, build = spark.conf.get(name), index.build
    monkeypatch.setattr(index, "build", lambda items, *a: seen.append(spark.conf.get(name)) or build(items, *a))
    monkeypatch.setattr(index, "BLOCK_ITEMS", 3)
    items = spark.range(8).select(F.col("id"), F.concat(F.lit("red fox "), F.repeat(F.lit("hen "), F.col("id").cast("int"))).alias("content"))
    queries = spark.createDataFrame([(0, "hen red")], "query_id int, query string")
    found = [r["item_id"] for r in index.search(items, queries, 3).orderBy("rank").collect()]
    assert found == [7, 6, 5] and seen == [str(4 << 20)] and spark.conf.get(name) == before
    sizes = []
    write = type(items.write).parquet
    monkeypatch.setattr(type(items.write), "parquet", lambda self, path, *a, **k: sizes.append((path, spark.conf.get(name))) or write(self, path, *a, **k))
    index.append(spark, f"file://{tmp_path}/kept", items)
    assert [n for p, n in sizes if "/segments/" in p] == [str(4 << 20)]
    assert index.score_counts(items, queries, 0.0).first()["n"] == 8
