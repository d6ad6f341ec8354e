"""A folder of package documents, whole and broken."""

import json

from recallgrid.sources.packages import import_folder, package_items, parse_packages
from recallgrid.sources.store import ParquetStore


def doc(name, version, *contents, **more):
    return {"name": name, "version": version, "source_model": "m", "memory": {"facts": [{"content": c} for c in contents], "goals_of_another": [1]}} | more


def test_folder(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put = lambda path, text: ((src / path).parent.mkdir(exist_ok=True), (src / path).write_text(text if isinstance(text, str) else json.dumps(text)))
    store = ParquetStore(spark, f"file://{tmp_path}/store")
    store.save("there", 3, spark.createDataFrame([("facts", 0, "i", "kept", 1.0, "", "", [])], "category string, pos int, id string, content string, confidence double, source string, origin string, redactions array<struct<kind:string,count:int>>"))
    put("env.json", {"format": "x", "package": doc(" env ", 2, "one", "two")})
    put("bare.json", doc("bare", None, "b") | {"memory": {"facts": [{"id": "own", "content": "b", "confidence": 0.25, "redactions": [{"kind": "email", "count": 2}]}], "decisions": None}})
    put("broken.json", '{"name": "x", ')
    put("list.json", "[1, 2]")
    put("empty.json", "")  # a scan passes over it
    put("blank.json", " ")
    put("nomemory.json", {"name": "x"})
    put("badname.json", doc("a/b", 1, "x"))
    put("nocontent.json", doc("nc", 1, "x", None))
    put("zero.json", doc("zero", 0, "x"))
    put("there.json", doc("there", 9, "new"))
    put("hollow.json", doc("hollow", 1))
    for v in (1, 2, 3):
        put(f"old/context_v{v}.json", doc("old", v, *[f"text {i}" for i in range(v)]))
    put("old/latest.json", doc("old", 2, "text 0", "rolled back"))
    put("large.json", doc("large", 1, "x" * 5000))
    told = {r["path"].split("/in/")[1]: r["problem"] for r in import_folder(store, f"file://{src}", limit=4000).collect()}
    assert told == {
        "env.json": None, "bare.json": None, "hollow.json": None, "broken.json": "not JSON", "blank.json": "not JSON", "list.json": "not a package", "nomemory.json": "not a package", "badname.json": "not a name",
        "nocontent.json": "no content", "zero.json": "not a version", "there.json": "exists", "large.json": "too large", "old/context_v1.json": None, "old/context_v2.json": "repeated", "old/context_v3.json": "after the current one", "old/latest.json": None,
    }
    assert store.list_packages() == ["bare", "env", "hollow", "old", "there"]
    assert store.list_versions("old") == [1, 2] and [r["content"] for r in store.load("old").orderBy("pos").collect()] == ["text 0", "rolled back"]
    assert store.load("hollow").collect() == [] and store.load("there").first()["content"] == "kept"
    b = store.load("bare").first()
    assert (b["id"], b["confidence"], [tuple(x) for x in b["redactions"]]) == ("own", 0.25, [("email", 2)])
    assert [(r["name"], r["version"], r["item_count"]) for r in store.summaries().collect()] == [("bare", 1, 1), ("env", 2, 2), ("hollow", 1, 0), ("old", 2, 2), ("there", 3, 1)]
    again = {r["problem"] for r in import_folder(store, f"file://{src}", limit=4000).filter("name in ('env', 'bare')").collect()}
    assert again == {"exists"} and store.load("env").count() == 2


def test_odd_documents(spark):
    rows = [("a", None), ("b", json.dumps({"package": {"name": "p", "memory": {}}})), ("c", json.dumps({"package": 5, "name": "q", "memory": {"facts": [{"content": "x", "id": ""}]}})), ("d", json.dumps({"name": "r", "memory": {"facts": [None]}}))]
    parsed = parse_packages(spark.createDataFrame(rows, "path string, raw string"))
    assert {r["path"]: r["problem"] for r in parsed.collect()} == {"a": "not JSON", "b": None, "c": None, "d": "no content"}
    assert [(r["name"], r["content"], len(r["id"])) for r in package_items(parsed).collect()] == [("q", "x", 12)]
    assert parse_packages(spark.createDataFrame([], "path string, raw string")).collect() == []
