"""Workers that tokenize get small batches of texts, and the session's own setting comes back."""

from recallgrid.llm import packing


def test_tokenizing_runs_on_small_batches(spark, monkeypatch):
    import public_tokenizers

    name, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", {}, packing.written
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "written", lambda df, what: seen.setdefault(what, spark.conf.get(name)) and write(df, what))
    docs = spark.createDataFrame([(i, "fox hen " * i) for i in range(40)], "doc_id long, text string")
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64).collect()
    assert sum(r["length"] for r in rows) >= 40 and {r["doc_id"] for r in rows} == set(range(40))
    assert seen["pieces"] == str(4 << 20) and spark.conf.get(name) == before
