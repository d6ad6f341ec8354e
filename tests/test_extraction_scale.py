"""Extraction runs its rules once a sentence after one deal by key, and leads lose nothing."""

import random
import re

from pyspark.sql import functions as F

from recallgrid.functions import constants as C
from recallgrid.operators import extract as X


def test_leads_lose_no_match(spark):
    r = random.Random(5)
    words = ["My", "name", "is", "I'm", "Im", "i am", "I work at", "call me", "Ann", "İm", "studying", "the", "application", "tool", "called", "built with", "Rust,", "and Go", "tech stack", "a", "student", "I", "using", "building a", "rocket.", "major", "my"]
    said = [" ".join(r.choices(words, k=r.randint(2, 7))) for _ in range(4000)]
    said = [s.upper() if i % 5 == 0 else s for i, s in enumerate(said)]
    plain = lambda patterns: X._any([F.col("s").rlike("(?i)" + p) for p in patterns])
    fires = X.rules(F.col("s"))
    got = spark.createDataFrame([(s,) for s in said], "s string").select(fires["identity"].alias("i"), fires["projects"].alias("p"), plain(C.IDENTITY_PATTERNS).alias("wi"), plain(C.PROJECT_PATTERNS).alias("wp"))
    assert got.filter("i <> wi or p <> wp").count() == 0 and got.filter("i").count() > 500 and got.filter("not i").count() > 500


def test_one_deal_by_key_and_no_rule_twice(spark):
    texts = spark.createDataFrame([(1, "User: I prefer tea at noon. I decided to stay here."), (2, None), (3, "x")], "k long, t string")
    plan = X.extract(texts, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    whole = X.extract(texts, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("i prefer") == 1 and len(re.findall("Human", whole)) <= 4  # user_messages once, clean twice where it is read
    assert sorted((r["key"], r["category"]) for r in X.extract(texts, "k", "t").collect()) == [(1, "decisions"), (1, "preferences")]
