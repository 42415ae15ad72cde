import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import edit, ordered, summary
from threadloom.schemas import Columns
from threadloom.plans import files, maintenance
from threadloom.sources import logs, shared


def threads(spark, rows):
    return spark.createDataFrame(rows, "id string, provider string")


def test_planned_threads_must_be_there_once(spark):
    now = [("a", "old"), ("b", "old"), ("c", "keep"), ("d", None), ("d", None)]
    plan = edit.plan_threads(threads(spark, now), ["old"], "new")
    assert sorted(map(str, edit.apply_threads(threads(spark, now), plan).collect())) == sorted(str(r) for r in threads(spark, [("a", "new"), ("b", "new"), *now[2:]]).collect())
    for changed in ([("b", "old")], [("a", "other"), ("b", "old")], [("a", "old"), ("a", "old"), ("b", "old")]):
        with pytest.raises(Exception, match="threads have changed"):
            edit.apply_threads(threads(spark, changed), plan).select("id").collect()


def test_rolled_back_threads(spark):
    plan = spark.createDataFrame([("a", "old", "new"), ("b", "old", "new"), ("c", "old", "new"), ("gone", "old", "new"), ("e", "old", "new")], "id string, old string, new string")
    got = edit.rollback_threads(threads(spark, [("a", "new"), ("b", "late"), ("c", "old"), ("d", "x"), ("e", None)]), plan).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [("a", "old", False), ("b", "late", True), ("c", "old", False), ("d", "x", False), ("e", None, True), ("gone", None, True)]


def test_a_backup_that_is_not_sound_restores_nothing(spark):
    record = lambda p: json.dumps({"type": "session_meta", "payload": {"id": "1", "model_provider": p}})
    lines = lambda rows: spark.createDataFrame(rows, "file_path string, line_number long, raw string").withColumn("record", F.parse_json("raw"))
    before = lines([("f", 1, record("old")), ("f", 2, record("keep"))])
    plan = edit.plan_relabel(logs.scan_assignments(before), ["old"], "new")
    image, after = edit.before_image(before, plan), edit.relabel_records(before, plan)
    back = edit.restore_records(after, image, before.where("line_number = 1"))
    assert sorted(json.loads(r[0])["payload"]["model_provider"] for r in back.select(F.to_json("record")).collect()) == ["keep", "old"]
    broken = lines([("f", 1, record("other"))])
    assert [r.sound for r in edit.check_image(image, broken).collect()] == [False] and [r.sound for r in edit.check_image(image, before).collect()] == [True]
    with pytest.raises(Exception, match="backup"):
        edit.restore_records(after, image, broken).select("line_number").collect()
    with pytest.raises(Exception, match="backup"):
        edit.restore_records(after, image, broken.where("false")).collect()
    with pytest.raises(Exception, match="stale plan"):
        edit.restore_records(lines([("f", 1, record("late"))]), image, before).collect()


def test_prompts_go_where_they_are_still_the_same(spark):
    docs = {"a": {"prompt": "p", "message": "m", "x": [1]}, "b": {"message": "m"}, "c": {"prompt": None, "message": "m"}, "d": {"entries": []}, "e": {"prompt": {"k": 1}}, "f": {"prompt": "p"}}
    d = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "file_path string, raw string").withColumn("record", F.parse_json("raw")).drop("raw")
    seen = {"a": '"p"', "b": '"m"', "c": '"m"', "d": "null", "e": '{"k":1}', "f": '"old"', "none": '"p"'}
    refs = spark.createDataFrame([*seen.items(), ("a", '"p"')], "file_path string, raw string").select("file_path", edit.entry_fingerprint(F.parse_json("raw")).alias("fingerprint"))
    left, stale = edit.redact_prompts(d, refs)
    got = {f: json.loads(j) for f, j in left.select("file_path", F.to_json("record")).collect()}
    assert got == docs | {"a": {"message": "m", "x": [1]}, "b": {}, "e": {}}
    assert sorted(r.file_path for r in stale.collect()) == ["c", "d", "f", "none"]


def test_search_texts_are_merged_in_the_order_of_the_parts(spark):
    s = "id string, file_path string, timestamp string, last_timestamp string, search_text string"
    rows = [("s", "b", "2026-01-01T12:00:00Z", "", "second"), ("s", "a", "2026-01-01T13:00:00+02:00", None, "first"), ("s", "c", None, None, "zeroth"), ("s", "c2", "", "", None)]
    rows += [("t", "a", "late", "", "é" * 10), ("t", "b", "early", "", "x"), ("u", "a", "2026-01-01T00:00:00Z", "", "")]
    got = {r.id: r.search_text for r in summary.merge_search_texts(spark.createDataFrame(rows, s), 40).collect()}
    assert got == {"s": "zeroth\n\nfirst\nsecond\n", "t": "x\n" + "é" * 10 + "\n", "u": "\n"}
    got = {r.id: r.search_text for r in summary.merge_search_texts(spark.createDataFrame(rows, s), 7, run_rows=1).collect()}
    assert got == {"s": "zeroth\n", "t": "x\néé\n", "u": "\n"}


def test_a_marker_stands_for_what_was_left_out(spark):
    m = Columns("s", ("i",), "role", "text")
    df = spark.createDataFrame([(s, i, "user", f"t{i}") for s, n in (("a", 7), ("b", 3)) for i in range(n)], "s string, i int, role string, text string")
    got = ordered.mark_omitted(ordered.head_tail(df, m, 3), m, 3, {"role": F.lit("system"), "text": F.lit("")}).orderBy("s", "ord").collect()
    assert [(r.s, r.i, r.role, r.ord, r.is_truncation_marker, r.omitted_count) for r in got if r.s == "a"] == [("a", 0, "user", 1, False, None), ("a", 1, "user", 2, False, None), ("a", None, "system", 3, True, 4), ("a", 6, "user", 7, False, None)]
    assert [r.ord for r in got if r.s == "b"] == [1, 2, 3]
    known = ordered.order_cross_file(df.withColumn("counted", F.lit(5)), "s", ["i"], 4, expected="counted").groupBy("s").agg(F.max("total"), F.max("omitted")).collect()
    assert sorted(map(tuple, known)) == [("a", 7, 3), ("b", 5, 2)]


def test_depth_and_roots(spark, tmp_path):
    for place in ("x.jsonl", "d/" * 15 + "y.jsonl", "d/" * 16 + "z.jsonl"):
        (tmp_path / "r (1)" / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r (1)" / place).write_text('{"a": 1}\n')
    root = str(tmp_path / "r (1)")
    names = lambda roots: sorted(r[0] for r in logs.read_jsonl(spark, roots, "codex").select(F.substring_index("file_path", "/", -1)).collect())
    assert names([root]) == names([root + "/"]) == ["x.jsonl", "y.jsonl"] and names([root + "/d"]) == ["y.jsonl", "z.jsonl"]
    assert names([f"{tmp_path}/r*"]) == ["x.jsonl", "y.jsonl", "z.jsonl"]
    sources = [(f"{tmp_path}/none", "codex", "Away"), (root, "codex", "Here"), (str(tmp_path), "codex", "Later"), (str(tmp_path), "gemini", "G"), (f"{tmp_path}/no", "claude_code", "C")]
    assert logs.present_sources(spark, sources) == [("codex", "Here"), ("gemini", "G")]


def test_a_set_hash_knows_rows_and_counts_not_order(spark):
    import random

    rng = random.Random(1)
    rows = [(f"f{rng.randrange(50)}", i % 700, rng.choice(("a", "b", None, "", "a:b"))) for i in range(3000)]
    of = lambda rows, n=4: edit.set_hash(spark.createDataFrame(rows, "path string, line int, provider string").repartition(n), "path", "line", "provider").first()[0]
    one = of(rows)
    assert len(one) == 64 and one == of(rows[::-1], 7)
    swapped = [(p, n, rows[1][2] if i == 0 else rows[0][2] if i == 1 else v) for i, (p, n, v) in enumerate(rows)]
    others = [rows[1:], [*rows, rows[0]], [*rows[1:], rows[1]], [(p, n, v or "") for p, n, v in rows], [*rows[1:], (*rows[0][:2], "new")], []]
    assert len({one, *(of(r) for r in others), of(swapped) if rows[0][2] != rows[1][2] else "x"}) == len(others) + 2
    # what joins of fields with a separator would take for the same
    assert of([("a\0b", 1, "")]) != of([("a", 1, "b\0")]) and of([("a", None, "1")]) != of([("a", 1, None)])


def test_documents_of_many_lines(spark, tmp_path):
    record = {"sessionId": "s", "cwd": "/p", "startedAt": 1767225600000, "entries": [{"type": "user", "n": i} for i in range(3)]}
    for name, text in (("one", json.dumps(record)), ("many", json.dumps(record, indent=2) + "\n"), ("bad", "{\n"), ("no", "[1,\n2]")):
        (tmp_path / f"{name}.json").write_text(text)
    docs = logs.read_documents(spark, [str(tmp_path)], "claude_code")
    assert sorted((r.id, r.cwd, r.timestamp) for r in docs.collect()) == [("s", "/p", "2026-01-01T00:00:00.000Z")] * 2
    assert logs.document_records(docs).count() == 6


def test_plans_and_backups_are_read_from_what_was_parsed_once(spark, tmp_path):
    labels = ["5-LOW", "1-URGENT", "3-MEDIUM"]
    spark.createDataFrame([(i, i % 7, labels[i % 3]) for i in range(30)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, "BUILDING") for i in range(7)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    with shared.run():
        held = {r.change: r.holds for r in files.plan_holds(spark, str(tmp_path)).collect()}
        back = maintenance.restore_records(spark, str(tmp_path))
        got = sorted((r.file_path, r.line_number, r.provider) for r in back.collect())
        kept = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in shared.places()}
        shared.forget(spark)
    assert held == {"same": True, "a line more": False, "a label changed": False, "another choice": False}
    assert got == sorted((str(i % 7), i, labels[i % 3]) for i in range(30))
    assert kept == {"records", "assignments", "plan"}


def test_records_are_not_broadcast_for_their_small_files(spark, tmp_path):
    labels = ["5-LOW", "1-URGENT", "3-MEDIUM", None]
    spark.createDataFrame([(i, i % 7, labels[i % 4]) for i in range(40)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    with shared.run():
        back = maintenance.restore_records(spark, str(tmp_path))
        # as files, records are a fiftieth of what they are in memory: by the files' size tables of millions of rows were broadcast
        assert "Broadcast" not in back._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == [(str(i % 7), i, labels[i % 4]) for i in range(40)]
        shared.forget(spark)


def test_a_line_is_parsed_once_for_its_assignment(spark, tmp_path):
    meta = lambda **p: {"type": "session_meta", "payload": p}
    lines = [meta(id="a", model_provider="old"), meta(id=1, model_provider="old"), meta(id="c", model_provider=5), meta(id="d", model_provider=None), meta(id="e"), {"type": "session_meta", "payload": "old"}]
    lines += [{"type": t, "payload": {"id": "x", "model_provider": "old"}} for t in (None, 1, ["session_meta"], {"session_meta": 1}, "event_msg")]
    raw = [*map(json.dumps, lines), "[1]", "null", "{"]
    spark.createDataFrame([("f", i, x) for i, x in enumerate(raw)], "file_path string, line_number long, raw string").write.parquet(f"{tmp_path}/lines")
    found = logs.scan_assignments(spark.read.parquet(f"{tmp_path}/lines").withColumn("record", F.try_parse_json("raw")))
    assert sorted(map(tuple, found.collect())) == [("f", 0, "a", "old"), ("f", 1, None, "old")]
    plan = edit.plan_relabel(found, ["old"], "new")
    assert plan._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert sorted(map(tuple, plan.collect())) == [("f", 0, "old", "new"), ("f", 1, "old", "new")]


def test_relabelling_changes_one_field_and_its_backup_may_hold_more_lines(spark):
    record = lambda p: {"model_provider": "old", "n": [1, None], "none": None, "payload": {"id": "é", "model_provider": p, "none": None, "payload": {"model_provider": "old", "x": {}}}, "type": "session_meta"}
    rows = [("f", 1, json.dumps(record("old"))), ("f", 2, json.dumps(record("keep"))), ("g", 1, json.dumps({"type": "other", "payload": [1]})), ("g", 2, None)]
    before = spark.createDataFrame(rows, "file_path string, line_number long, raw string").withColumn("record", F.try_parse_json("raw")).drop("raw")
    of = lambda df: {(f, n): j and json.loads(j) for f, n, j in df.select("file_path", "line_number", F.to_json("record")).collect()}
    plan = edit.plan_relabel(logs.scan_assignments(before), ["old"], "new")
    image, after = edit.before_image(before, plan), edit.relabel_records(before, plan)
    assert of(after) == of(before) | {("f", 1): record("new")}
    assert [(r.session_id, r.old, r.new) for r in image.collect()] == [("é", "old", "new")]
    assert [r.sound for r in edit.check_image(image, before).collect()] == [True]
    assert of(edit.restore_records(after, image, before)) == of(before)
    gone = plan.unionByName(spark.createDataFrame([("gone", 1, "old", "new")], plan.schema))
    assert sorted((r.path, r.record_sha256 is None, r.sound) for r in edit.check_image(edit.before_image(before, gone), before).collect()) == [("f", False, True), ("gone", True, False)]
