"""Rows of dense tiles come without null arrays, over which the Arrow writer would go again with each row."""

from recallgrid.llm import divergence


def test_tile_rows_have_no_null_arrays(spark, monkeypatch):
    sums = divergence.tile_sums

    def whole(tile):
        assert tile["za"].notna().all() and tile["zb"].notna().all()
        return sums(tile)

    monkeypatch.setattr(divergence, "tile_sums", whole)
    docs = spark.createDataFrame([("en", s, "red fox " * n) for s, n in (("a", 1), ("b", 2), ("c", 3))], "lang string, source string, text string")
    rows = divergence.audit(docs, least_docs=2).filter("part = 'pair'").collect()
    # both terms are as frequent in each source: (n + 5) / (2 n + 10) is a half
    assert len(rows) == 6 and {r["value"] for r in rows} == {0}
