import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import ordered, runs
from threadloom.schemas import Columns

M = Columns("s", ("i", "j"), "role", "text", "", "kind")


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for s, many in [("big", 900), (None, 400), ("a", 1), ("b", 37), *((f"s{k}", rng.randrange(1, 60)) for k in range(40))]:
        kinds = ("event_msg", "response_item", "response_item", "other", None)
        said, role = "x", "user"
        for i in range(many):
            if rng.random() < 0.3:  # long islands, so that some reach over a border
                said, role = rng.choice(("x", "y", None, "é" * rng.randrange(9))), rng.choice(("user", "assistant", None))
            rows.append((s, i // 3, i % 3, role, said, rng.choice(kinds), rng.choice((None, "c1", "c2")), rng.choice((None, None, "n1", "n2")), n))
            n += 1
    return spark.createDataFrame(rows, "s string, i int, j int, role string, text string, kind string, call string, name string, n int").repartition(6).cache()


OPERATORS = {
    "mirrored": lambda df, r: ordered.drop_mirrored(df, M, run_rows=r),
    "head_tail": lambda df, r: ordered.head_tail(df, M, 11, r),
    "names": lambda df, r: ordered.resolve_tool_names(df, "s", "call", ["i", "j"], F.col("name"), r),
    "numbered": lambda df, r: ordered.numbered(df, ["s"], ["i", "j"], r),
    "document": lambda df, r: ordered.search_document(df, M, 700, r),
    "document of nothing": lambda df, r: ordered.search_document(df, M, 1, r),
    "cross_file": lambda df, r: ordered.order_cross_file(df, "s", ["i", "j"], 4, r),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_runs_give_the_rows_of_one_window(spark, turns, name):
    f = OPERATORS[name]
    want = sorted(map(str, f(turns, None).collect()))
    assert len(want) > 40
    for rows in (25, 100):
        got = f(turns, rows)
        assert got.columns == f(turns, None).columns
        assert sorted(map(str, got.collect())) == want


def test_no_run_holds_a_long_session(spark, turns):
    rows, cut = runs.in_runs(turns, ["s"], ["i", "j"], 50)
    assert cut and rows.count() == turns.count()
    most = {(r.s, r["_run"]): r["count"] for r in rows.groupBy("s", "_run").count().collect()}
    long = {s for s, run in most if run >= 0}
    assert {"big", None} <= long and all(run >= 0 for s, run in most if s in long)
    assert max(most.values()) <= 100  # of 900 in a session; ranges are as even as Spark's samples of the order
    of_run = rows.where("_run >= 0").groupBy("_run").agg(F.min(F.struct("s", "i", "j")).alias("a"), F.max(F.struct("s", "i", "j")).alias("b")).orderBy("_run").collect()
    key = lambda r: (r.s is not None, r.s or "", r.i, r.j)
    assert all(key(x.b) < key(y.a) for x, y in zip(of_run, of_run[1:]))
    # what follows deals by session and run: no task of the windows has more rows than two runs and some short sessions
    plan = ordered.numbered(turns, ["s"], ["i", "j"], 50)._jdf.queryExecution().toString()
    assert "_run" in plan.split("Window", 1)[1]


def test_short_sessions_are_not_cut(spark, turns):
    for rows in (None, 900, 1_000_000):
        out, cut = runs.in_runs(turns, ["s"], ["i", "j"], rows)
        assert not cut and out.where("_run <> -1").isEmpty()
    assert not runs.in_runs(turns.limit(0), ["s"], ["i", "j"], 1)[1]


def test_runs_grow_where_there_would_be_too_many(spark, turns, monkeypatch):
    monkeypatch.setattr(runs, "MOST_RUNS", 4)
    rows, cut = runs.in_runs(turns, ["s"], ["i", "j"], 50)
    assert cut and rows.agg(F.countDistinct("_run")).first()[0] <= 5


def test_messages_of_files_in_runs(spark):
    """Records of a long file and of short ones: the same messages in one window and in runs."""
    import json

    from threadloom.operators import normalize

    rng = random.Random(12)
    block = lambda: rng.choice([{"type": "text", "text": rng.choice(("hi", "there", " "))}, {"type": "tool_use", "id": rng.choice(("a", "b")), "name": rng.choice(("run", "read")), "input": {}}, {"type": "tool_result", "tool_use_id": rng.choice(("a", "b", "c")), "content": "done"}])
    record = lambda: rng.choice([
        {"type": rng.choice(("user", "assistant")), "message": {"content": [block() for _ in range(rng.randrange(3))]}},
        {"type": rng.choice(("event_msg", "response_item")), "payload": {"type": "agent_message", "message": rng.choice(("same", "same", "other"))}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": rng.choice(("a", "b")), "output": "x"}},
    ])
    rows = [(f, i + 1, json.dumps(record())) for f, n in (("long", 400), ("b", 30), ("c", 1)) for i in range(n)]
    records = spark.createDataFrame(rows, "file_path string, line_number long, raw string").withColumn("record", F.parse_json("raw"))
    want = sorted(map(str, normalize.normalize(records).collect()))
    assert len(want) > 250
    for rows in (20, 10_000):
        assert sorted(map(str, normalize.normalize(records, run_rows=rows).collect())) == want
    plan = normalize.normalize(records)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1
