import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.plans import files
from threadloom.sources import arrays, logs, snapshots


def value(rng, deep=0):
    kind = rng.randrange(8 if deep < 4 else 5)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "a", "\n", "é", "日", " ", "\\\\", '\\"']) for _ in range(rng.randrange(12)))
    if kind < 5:
        return rng.choice([None, True, 1, -2, 10**12, "sessionId"])
    if kind < 6:
        return [value(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}{rng.choice(',]}')}": value(rng, deep + 1) for i in range(rng.randrange(4))}


BROKEN = ['{"a": 1, "b": 2}', "[1, 2", "[1, 2,]", "[1,, 2]", '["a, "b"]', "[1 2, 3]", '[{"a": 1}}, 2]', '["\\,", 1]', "", "  ", "1, 2", '["a]', "[,]", "[1, [2, 3]", '[{"a": [}, 1]', "x[1, 2]"]


@pytest.mark.parametrize("split", ["1k", "64", "7", "128m"])
def test_elements_of_any_array_by_ranges(spark, tmp_path, split):
    rng = random.Random(split)
    want = {}
    for i in range(12):
        items = [value(rng) for _ in range(rng.choice((0, 1, 2, 40)))]
        text = json.dumps(items, ensure_ascii=bool(i % 2), indent=rng.choice((None, 1)), separators=rng.choice(((",", ":"), (" , ", " : "))))
        (tmp_path / f"a{i}.json").write_text(rng.choice(("", " \n")) + text + rng.choice(("", "\n", " ")))
        want[f"a{i}.json"] = items
    for i, text in enumerate(BROKEN):
        (tmp_path / f"bad{i}.json").write_text(text)
    (tmp_path / "end.json").write_text("[1, 2], [3, 4] and more]")
    want["end.json"] = [1, 2]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if split != "7" else "64k")
    try:
        rows = arrays.array_elements(arrays.scan_arrays(spark, [str(tmp_path)])).select(F.element_at(F.split("file_path", "/"), -1), "line_number", F.to_json("record")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    got = {}
    for name, at, record in sorted(map(tuple, rows), key=lambda r: r[:2]):
        assert at == len(got.setdefault(name, []))
        got[name].append(json.loads(record))
    assert got == {k: v for k, v in want.items() if v}


def test_array_logs_are_found_where_they_belong(spark, tmp_path):
    for place in ("tmp/logs.json", "tmp/a/logs.json", "tmp/a/b/logs.json", "tmp/a/b/c/logs.json", "tmp/a/other.json", "logs.json"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(json.dumps([{"sessionId": place, "x": "a,b"}, {"sessionId": 3}, 5, None, {"x": "no id"}, {"sessionId": "second"}]))
    got = logs.read_array_logs(spark, [str(tmp_path)]).select("line_number", "id").collect()
    assert sorted(map(tuple, got)) == sorted((n, i) for p in ("tmp/logs.json", "tmp/a/logs.json", "tmp/a/b/logs.json") for n, i in ((0, p), (5, "second")))


def test_no_task_holds_a_large_array(spark, tmp_path):
    """A file of many ranges: no row after the scan is larger than an element, no partition than a few ranges."""
    (tmp_path / "big.json").write_text("[" + ",".join(json.dumps({"sessionId": str(i), "text": "x, " * 40}) for i in range(20_000)) + "]")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        text = arrays.scan_arrays(spark, [str(tmp_path)])
        assert text.rdd.getNumPartitions() > 8
        out = arrays.of_sessions(arrays.array_elements(text))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert out.count() == 20_000 and out.agg(F.max("line_number"), F.max(F.abs(F.col("line_number") - F.col("id").cast("long")))).first()[:] == (19_999, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert "wholetext" not in plan
    assert text.agg(F.max(F.length("value"))).first()[0] < 60


def test_array_logs_come_back_from_a_new_version(spark, tmp_path):
    items = [{"sessionId": "s", "n": i, "t": "a\n]b,["} for i in range(300)] + [None, 5, []]
    rows = [("f", 7 * i, json.dumps(x)) for i, x in enumerate(items)] + [("g", 3, "1")]
    elements = spark.createDataFrame(rows, "file_path string, line_number long, raw string").withColumn("record", F.parse_json("raw"))
    files = spark.createDataFrame([("f",), ("h",), ("g",)], "file_path string")
    snapshots.write_array_logs(elements, f"{tmp_path}/v", files)
    back = snapshots.read_array_logs(spark, f"{tmp_path}/v").select("file_path", "line_number", F.to_json("record")).collect()
    assert sorted((f, n, json.loads(r)) for f, n, r in back if f == "f") == [("f", i, x) for i, x in enumerate(items)]
    assert [tuple(r) for r in back if r.file_path == "g"] == [("g", 0, "1")]
    parts = sorted((tmp_path / "v" / "file_path=f").glob("part-*"))
    assert json.loads("".join(p.read_text() for p in parts)) == items
    assert json.loads("".join(p.read_text() for p in (tmp_path / "v" / "file_path=h").glob("part-*"))) == []


@pytest.mark.parametrize("row", [(None, 1, "a"), ("", 1, "a"), ("f", 1, "a\nb")])
def test_lines_that_would_not_come_back_are_refused(spark, tmp_path, row):
    lines = spark.createDataFrame([row, ("f", 2, "fine")], "file_path string, line_number long, raw string")
    with pytest.raises(Exception, match="a line with"):
        snapshots.write_snapshot(lines, f"{tmp_path}/v")


def test_lines_are_numbered_without_a_shuffle_of_them(spark, tmp_path):
    want = {}
    for i in range(7):
        lines = [f"{i}:{k}" for k in range(1 + 40 * i)]
        (tmp_path / f"f{i}.jsonl").write_text("\n".join(lines) + ("\n" if i % 2 else ""))
        want |= {(f"f{i}.jsonl", k + 1): x for k, x in enumerate(lines)}
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.autoBroadcastJoinThreshold"]
    was = {n: spark.conf.get(n) for n in names}
    try:
        for split in ("50", "300", "1m"):
            for n, v in zip(names, (split, "10", "-1")):
                spark.conf.set(n, v)
            out = logs.read_jsonl(spark, [str(tmp_path)], "codex").select(F.element_at(F.split("file_path", "/"), -1), "line_number", "raw")
            assert {(f, n): x for f, n, x in out.collect()} == want
            plan = out._jdf.queryExecution().executedPlan().toString()
            exchanges = [x for x in plan.split("== Initial Plan ==")[0].splitlines() if "Exchange" in x and "Broadcast" not in x]
            assert exchanges and not any("raw" in x or "value" in x for x in exchanges) and "SortMergeJoin" not in plan
    finally:
        for n, v in was.items():
            spark.conf.set(n, v)


def test_array_logs_of_turns_that_are_there_twice(spark, tmp_path):
    turns = [(c, t) for c in range(55) for t in range(4)] + [(0, 0), (49, 3), (50, 0), (54, 3)]
    spark.createDataFrame([(c, t, "user", "said") for c, t in turns], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    logs_of: dict[int, list] = {}
    for c, t in sorted(turns):
        logs_of.setdefault(c // 50, []).append((c, t))
    want = sorted((f"/logs/b{b}", n, str(c), t) for b, found in logs_of.items() for n, (c, t) in enumerate(found) if t < 2)
    assert sorted(tuple(r) for r in files.array_log_elements(spark, str(tmp_path)).collect()) == want
