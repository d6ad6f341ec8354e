"""Terms and turns of texts, against plain readings of their rules."""

import json
import random
import re

from pyspark.sql import functions as F

from recallgrid.functions import text as T
from recallgrid.functions.constants import STOPWORDS


def ending_cut(t):
    if t.isdigit():
        return t
    for least, end, to in ((6, "ies", "y"), (7, "ing", ""), (6, "ed", "")):
        if len(t) >= least and t.endswith(end):
            return t[: -len(end)] + to
    return t[:-1] if len(t) > 3 and t.endswith("s") and t[-2:] not in ("ss", "us", "is") else t


def plain_terms(s):
    raw = (t.strip("._-") for t in re.findall(r"[a-z0-9][a-z0-9+#._\-]*", (s or "").lower()))
    return [ending_cut(t) for t in raw if len(t) >= 2 and t not in STOPWORDS]


def test_terms(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeginsty19+#._- .-\n\té") for _ in range(rng.randrange(120))) for _ in range(1000)]
    texts += ["proceeding ties dies parties bodies going doings bus this is glass seeds 2020s c++ c# ..a.. --x-y- a.b.c. +++ node.js_ The AND i am", "", None, "x" * 5000, " ".join(STOPWORDS)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokenize(F.col("t")).alias("w")).collect()
    assert all(list(r["w"]) == plain_terms(r["t"]) for r in got)


def test_turns(spark):
    cases = {
        "User: a\x01b\x02c": [("user", "a\x01b\x02c")],
        "intro\nHuman : hi\n\nAI: yes:\nSystem: go": [("user", "hi"), ("assistant", "yes:"), ("system", "go")],
        "User:\nAssistant: only": [("assistant", "only")],
        "  just text ": [("user", "just text")],
        json.dumps([{"role": "assistant", "content": "x\ny"}, {"content": "z"}, {"role": "bot"}]): [("assistant", "x\ny"), ("user", "z"), ("bot", "")],
        "[]": [],
        '{"role": "user"}': [("user", '{"role": "user"}')],
        "[not json": [("user", "[not json")],
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.transcript_turns(F.col("t")).alias("x")).collect()
    assert {r["t"]: [tuple(x) for x in r["x"]] for r in got} == cases
