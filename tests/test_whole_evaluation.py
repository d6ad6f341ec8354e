"""Every query is evaluated, however many there are."""

from pyspark.sql import functions as F

from recallgrid.plans import catalog


def test_all_queries_are_evaluated(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    b.unionByName(b.filter("item_id < 20").withColumn("item_id", F.col("item_id") + 40)).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {r["doc_id"] % 60 for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    got = {r["query_id"] for r in catalog.QUERIES["evaluate_retrieval"](spark, str(tmp_path)).collect()}
    assert got == want and max(got) >= 40
