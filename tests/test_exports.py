"""Chat exports against a walk of each tree, node by node."""

import json
import random

from recallgrid.sources.exports import export_messages, export_texts, read_exports
from recallgrid.sources.files import export_text


def tree(rng, n, chain=False):
    mapping = {}
    names = [f"n{i}-{rng.randrange(10**6)}" for i in range(n)]
    for i, k in enumerate(names):
        body = rng.choice(["plain %d" % i, {"content_type": "text", "parts": ["a%d" % i, {"asset": 1}, "b"]}, {"parts": []}, "  ", None, {"text": "x"}])
        mapping[k] = {"parent": None, "children": [], "message": rng.choice([None, {"author": {"role": rng.choice(["user", "assistant", "system", "tool"])}, "content": body}])}
    for i in range(1, n):
        over = names[i - 1] if chain else names[rng.randrange(i)]
        mapping[names[i]]["parent"] = over
        mapping[over]["children"].insert(0 if rng.random() < 0.5 else len(mapping[over]["children"]), names[i])
    order = list(mapping)
    rng.shuffle(order)
    return {k: mapping[k] for k in order}


def test_trees_equal_a_walk(spark):
    rng = random.Random(5)
    files = [[{"title": f"T{i}.{j}", "mapping": tree(rng, rng.randrange(1, 40), chain=j == 1)} for j in range(3)] for i in range(12)]
    files.append([{"title": "deep", "mapping": tree(rng, 700, chain=True)}])
    files.append([{"mapping": {}}, {"title": "no messages"}])
    got = {r["key"]: r["text"] for r in export_texts(spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(files)], "i int, raw string"), "i", "raw").collect()}
    assert got == {i: export_text(f) for i, f in enumerate(files)}


def test_odd_exports(spark):
    say = lambda t, r="user": {"author": {"role": r}, "content": t}
    rootless = {"a": {"parent": "b", "message": say("one")}, "b": {"parent": "a", "children": ["a"], "message": say("two", "tool")}, "c": {"parent": "a", "message": say("three", "system")}}
    circle = {"r": {"parent": None, "children": ["x", "gone", "x"], "message": say("top")}, "x": {"parent": "r", "children": ["r"], "message": say("below")}, "y": {"parent": "z", "children": ["z"]}, "z": {"parent": "y", "children": ["y"], "message": say("never")}, "lost": {"parent": "r", "children": ["under"], "message": say("unlisted")}, "under": {"parent": "lost", "message": say("unlisted too")}}
    shared = {"r": {"parent": None, "children": ["p", "q"], "message": None}, "p": {"parent": "r", "children": ["s"], "message": say("p")}, "q": {"parent": "r", "children": ["s"], "message": say("q")}, "s": {"parent": "q", "message": say("s")}}
    rows = [("rootless", [{"mapping": rootless}]), ("circle", [{"mapping": circle}]), ("shared", [{"mapping": shared}]), ("number", [{"mapping": {"r": {"message": say(7)}}}])]
    texts = [(k, json.dumps(v)) for k, v in rows] + [("broken", "[{"), ("object", "{}"), ("empty", ""), ("none", None), ("nothing", "[]")]
    df = spark.createDataFrame(texts, "k string, raw string")
    got = {}
    for r in sorted(export_messages(df, "k", "raw").collect(), key=lambda r: (r["key"], r["conv"], r["place"])):
        got.setdefault(r["key"], []).append(r["content"])
    assert got == {"rootless": ["one", "three"], "circle": ["top", "below"], "shared": ["p", "q", "s"], "number": ["7"]}
    assert export_texts(df.limit(0), "k", "raw").collect() == []


def test_files_are_read(spark, tmp_path):
    one = [{"title": "A", "mapping": {"r": {"message": {"author": {"role": "user"}, "content": "hello"}}}}]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "conversations.json").write_text(json.dumps(one))
    assert [r["text"] for r in read_exports(spark, f"file://{tmp_path}").collect()] == ["\n=== Conversation: A ===\n\n\nUser: hello"]
