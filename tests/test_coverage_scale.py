"""Coverage of gold items: one join, ids that recur, labels without a number."""

from recallgrid.operators.evaluate import extraction_coverage


def test_coverage_shuffles_the_items_once_and_counts_ids(spark):
    items = spark.createDataFrame([(1, "a", "Red fox"), (1, "a", "red hen"), (1, "b", "blue"), (1, None, "red"), (2, "c", "none"), (4, "d", "red")], "fixture long, id string, content string")
    gold = spark.createDataFrame([(1, 0, ["red"]), (1, 1, ["RED", "fox"]), (1, 1, ["hen"]), (1, None, ["blue"]), (2, 0, ["red"]), (3, 0, ["x"])], "fixture long, gold_idx int, keywords array<string>")
    out = extraction_coverage(items, gold)
    got = {r["fixture"]: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (4, 4, 0.5, 0.5), 2: (1, 1, 0.0, 1.0), 3: (1, 0, 0.0, 0.0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
