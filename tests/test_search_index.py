import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import query, search_index


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "épée", "日本語", "THE", "x", "of"]
    rows = [(f"s{i}", " ".join(rng.choices(words, k=30)) + (f" Needle{i % 2000}" if i % 500 == 7 else "")) for i in range(3000)] + [("n", None), ("e", ""), ("two", "ab")]
    docs = spark.createDataFrame(rows, "session_key string, search_text string").withColumn("n", F.lit(1))
    path = f"{tmp_path_factory.mktemp('index')}/v1"
    search_index.write_index(docs, path, parts=60)
    return docs, path


def files_read(df):
    """Files that the scans of a query's documents read, from the metrics of the plan that ran."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name.startswith("Scan parquet") and "documents" in node.toString():
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(found)


@pytest.mark.parametrize("asked", ["needle7", "NEEDLE507", "Alpha beta", "épée 日本語", "日本", "the x", "x", "of ab", "zzzz", "alpha zzzz", "needle7 alpha"])
def test_rows_are_those_of_the_full_scan(spark, index, asked):
    docs, path = index
    got = search_index.search(spark, path, asked)
    want = query.search(docs, asked)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_rare_term_reads_few_files(spark, index):
    docs, path = index
    every = spark.read.parquet(f"{path}/documents")
    n = len(every.inputFiles())
    rare = search_index.search(spark, path, "needle507", with_snippet=False)
    assert n >= 60 and 1 <= files_read(rare) < n / 10
    assert files_read(search_index.search(spark, path, "alpha")) == n
    assert files_read(search_index.search(spark, path, "nowhere at all")) == 0


def test_an_empty_index(spark, index, tmp_path):
    search_index.write_index(index[0].limit(0), f"{tmp_path}/v", parts=3)
    assert search_index.search(spark, f"{tmp_path}/v", "alpha").count() == 0
