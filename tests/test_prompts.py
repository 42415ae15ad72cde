import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import edit, prompts


def corpus(rng):
    heads = ["Please look at the file and ", "Please look at the file", "aaaaaaaaaaaaaaaaaaaaaaaa", "日本語の文章をここに書いておきます、よろしく", "ab" * 60]
    text = lambda: rng.choice(("", "so: ", "é")) + rng.choice(heads) + "".join(rng.choice("ab é") for _ in range(rng.randrange(90)))
    artifacts = [(rng.choice(("s1", "s2", "big", None)), rng.choice((text(), text()[:15], "", None, "short one"))) for _ in range(400)]
    messages = [(rng.choice(("s1", "s2", "s3", "big", "big", None)), rng.choice((text(), "x " + text() + " y", "short one", "", None))) for _ in range(300)]
    return artifacts, messages


def repeats(a, m):
    start = a[:80]
    return start in m if len(start) >= 16 else a == m


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_version(spark, seed):
    artifacts, messages = corpus(random.Random(seed))
    a = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(artifacts)], "conv string, text string, value int").repartition(4)
    m = spark.createDataFrame(messages, "conv string, text string").withColumn("value", F.lit("clash")).repartition(5)
    got = sorted(r.value for r in edit.drop_duplicate_prompts(a, m, session="conv").collect())
    want = [i for i, (s, t) in enumerate(artifacts) if s is None or t is None or not any(s == x and y is not None and repeats(t, y) for x, y in messages)]
    assert got == want and 100 < len(want) < 390
    assert edit.drop_duplicate_prompts(a, m.limit(0), session="conv").count() == 400 and edit.drop_duplicate_prompts(a.limit(0), m, session="conv").count() == 0


def test_large_sessions_are_dealt_over_tasks(spark):
    artifacts, messages = corpus(random.Random(3))
    keys = spark.createDataFrame([(s, t[:80]) for s, t in artifacts if t is not None], "session string, value string")
    said = spark.createDataFrame(messages, "session string, value string")
    want = sorted({(s, t[:80]) for s, t in artifacts if s and t and any(s == x and y is not None and t[:80] in y for x, y in messages)})
    for size, most in ((1 << 20, 1000), (500, 1000), (1 << 20, 7), (500, 7)):
        out = prompts.contained(keys, said, bucket_bytes=size, most_prompts=most)
        assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "contains(" not in plan.lower()
