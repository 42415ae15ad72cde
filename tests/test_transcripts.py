import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import edit, normalize, ordered, summary
from threadloom.schemas import Columns
from threadloom.sources import logs


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.compact(lit("abcdefgh"), 6)) == "abc..."
    assert one(spark, T.compact_title(lit("\n\n## > Fix it\nnow"), 80)) == "Fix it"
    assert one(spark, T.local_day(lit("2026-01-01T23:30:00-02:00"))) == "2026-01-02"
    assert one(spark, T.local_day(lit("2026-01-01 or so"))) == "2026-01-01"
    assert one(spark, T.local_day(lit("ééééééé"))) == "ééééé"
    assert one(spark, T.local_day(lit("日本語日本語"))) is None and one(spark, T.local_day(lit("日本"))) is None
    assert one(spark, T.snippet(lit("abc def"), "zzz")) == "" and one(spark, T.snippet(lit("abc def"), "zzz def")) == "abc def"
    assert one(spark, T.snippet(lit("abc"), " ")) == "" and one(spark, T.snippet(lit("abc"), "")) == "abc" and one(spark, T.snippet(lit("x" * 99 + "the a the "), "the ")).startswith("x" * 60 + "the a")
    assert one(spark, T.snippet(lit("x" * 99 + "the, " + "y" * 99 + "the "), "the ")) == "y" * 60 + "the " and one(spark, T.snippet(lit(None).cast("string"), "a")) is None
    assert one(spark, T.epoch_or_text(lit("1767225600000"))) == "2026-01-01T00:00:00.000Z"
    assert one(spark, T.basename(lit("/tmp/project/"))) == "project"
    assert one(spark, T.basename(lit("/"))) is None
    assert one(spark, T.clip_bytes(lit("aéé"), lit(4))) == "aé"
    assert one(spark, T.safe_link(lit("javascript:x"))) is False
    assert one(spark, T.valid_session_id(lit("a/b"))) is False


def test_mirrored_messages_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.choice("ab"), rng.choice(["event_msg", "response_item", "other"])) for s in range(40) for i in range(12)]
    m = Columns("s", ("i",), "t", "t", "", "k")
    got = {tuple(r) for r in ordered.drop_mirrored(spark.createDataFrame(rows, "s int, i int, t string, k string"), m).collect()}
    want, last = set(), {}
    for r in rows:
        p = last.get(r[0])
        if p and p[2] == r[2] and {p[3], r[3]} == {"event_msg", "response_item"}:
            continue
        last[r[0]] = r
        want.add(r)
    assert got == want


def test_jsonl_is_numbered_and_read(spark, tmp_path):
    rows = [{"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "s-1"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "fix it"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "done"}}]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(rows[0]), "", *map(json.dumps, rows[1:]), "{bad"]) + "\n")
    records = logs.read_jsonl(spark, [str(tmp_path)], "codex")
    assert sorted(r.line_number for r in records.collect()) == [1, 3, 4, 5]
    assert [r.line_number for r in logs.parse_errors(records).collect()] == [5]
    one = summary.summarize_records(records, normalize.normalize(records)).first()
    assert (one.session_key, one.title, one.preview_text, one.event_count, one.message_count, one.role_counts) == ("codex:s-1", "fix it", "done", 3, 2, {"user": 1, "assistant": 1})
    got = sorted((r.line_number, r.role, r.text) for r in normalize.normalize(records).collect())
    assert got == [(3, "user", "fix it"), (4, "assistant", "done")]


def test_array_logs_and_documents(spark, tmp_path):
    elements = [{"sessionId": "a", "message": "x"}, {"message": "y"}, {"sessionId": 1}, {"sessionId": None}, 5, {"sessionId": "b"}]
    for depth, name in enumerate(["tmp", "tmp/x", "tmp/x/tmp", "tmp/x/tmp/z"]):
        (tmp_path / name).mkdir()
        (tmp_path / name / "logs.json").write_text(json.dumps(elements if depth < 3 else [{"sessionId": "too deep"}]))
    (tmp_path / "tmp" / "other.json").write_text(json.dumps(elements))
    got = logs.read_array_logs(spark, [str(tmp_path)]).collect()
    assert sorted((r.id, r.line_number) for r in got) == [("a", 0)] * 3 + [("b", 5)] * 3


def test_relabel_touches_planned_lines_and_rolls_back(spark):
    a = spark.createDataFrame([("f", 1, "old"), ("f", 2, "keep")], "path string, line_number long, provider string")
    plan = edit.plan_relabel(a, ["old"], "new")
    done = edit.apply_relabel(a, plan)
    assert sorted(r.provider for r in done.collect()) == ["keep", "new"]
    assert sorted(r.provider for r in edit.rollback_relabel(done, plan).collect()) == ["keep", "old"]


def test_a_planned_line_that_has_vanished_is_refused(spark):
    a = spark.createDataFrame([("f", 1, "old"), ("f", 2, "old")], "path string, line_number long, provider string")
    plan = edit.plan_relabel(a, ["old"], "new")
    records = spark.createDataFrame([("f", i, json.dumps({"type": "session_meta", "payload": {"model_provider": "old", "id": "s"}})) for i in (1, 2)], "file_path string, line_number long, raw string").withColumn("record", F.parse_json("raw"))
    assert edit.relabel_records(records, plan).count() == 2
    for changed in (edit.apply_relabel(a.where("line_number = 1"), plan), edit.relabel_records(records.where("line_number = 2"), plan), edit.apply_relabel(a.withColumn("provider", F.lit("third")), plan)):
        with pytest.raises(Exception, match="stale plan"):
            changed.select(changed.columns[0]).collect()
    image = edit.before_image(records, plan).collect()
    assert [(r.session_id, r.old, r.new, r.file_sha256, len(r.record_sha256)) for r in image] == [("s", "old", "new", None, 64)] * 2


def test_entry_works_without_the_training_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
