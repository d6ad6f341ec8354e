"""Scores in reasons are rounded as printf rounds them, whose ties are those of the exact value."""

from pyspark.sql import functions as F

from recallgrid.functions import text as T


def test_reason_rounds_by_the_exact_value(spark):
    scores = [i / 10_000 for i in range(10_001)] + [0.1 + 0.2, 1 / 3]  # 0.125 lies between, 0.145 and 0.615 are not what they seem
    df = spark.createDataFrame([(x, f"'a' (lexical {x:.2f}); embedding similarity {x:.2f}") for x in scores], "x double, want string")
    got = df.select("want", F.replace(T.reason(F.array(F.lit("a")), F.col("x"), F.col("x")), F.lit("Matched "), F.lit("")).alias("got"))
    assert got.filter("got <> want").collect() == []
    none = spark.range(1).select(T.reason(F.array(F.lit("a")), F.lit(0.125), F.lit(None).cast("double")).alias("r")).first()["r"]
    assert none == "Matched 'a' (lexical 0.12)"
