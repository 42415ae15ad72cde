"""Session documents with their history, exports, pages, redaction and merged summaries on small rows."""

import json

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import edit, export, query, summary
from threadloom.schemas import Columns
from threadloom.sources import logs


def one(spark, *cs):
    got = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cs))).first()
    return got[0] if len(cs) == 1 else tuple(got)


def lines(spark, rows):
    df = spark.createDataFrame([("f", i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "file_path string, line_number long, raw string")
    return df.withColumn("record", F.try_parse_json("raw"))


def test_shown_text(spark):
    lit = F.lit
    assert one(spark, T.compact_text(lit("abc  defgh"), 7)) == "abc..."
    assert one(spark, T.compact_text(lit("ab\U0001f600cdef"), 6)) == "ab..."  # half a pair isn't kept
    assert one(spark, T.compact_text(lit(None).cast("string"), 6)) == ""
    assert one(spark, T.utf16_length(lit("a\U0001f600"))) == 3
    null = lit(None).cast("long")
    assert one(spark, T.display_text(lit("x"), lit(False), null), T.display_text(lit("x"), lit(False), lit(3)), T.display_text(lit(None).cast("string"), lit(False), null)) == ("x", "3 messages in the middle were omitted for safe display", "")
    assert one(spark, T.display_text(lit("ab"), lit(True), null)) == "ab\n\nThis message is too large; only the first 2 characters are shown"
    assert one(spark, T.display_time(lit("2026-01-02T15:04:05Z")), T.display_time(lit("then")), T.display_time(lit(""))) == ("Jan 2, 2026, 3:04:05 PM", "then", "Unknown time")
    fold = lambda r, c, t: T.starts_collapsed(lit(r), lit(c), lit(t))
    assert one(spark, fold("tool", False, ""), fold("user", True, ""), fold("user", False, "a" * 1800), fold("user", False, "a" * 1801), fold(None, None, None)) == (True, True, False, True, False)
    assert one(spark, T.shown_kind(lit("codex"), lit(True), lit("codex")), T.shown_kind(lit("codex"), lit(True), lit("")), T.shown_kind(lit(None), lit(False), lit("codex"))) == ("codex_archived", "codex", "unknown")


def test_markdown_becomes_plain(spark):
    got = one(spark, T.markdown_plain_text(F.lit("# Head\n\n> said\n- **one** `two`\n1) three\n***\n```py\nx = 1\n```\n| a | b |\n|---|---|\n![pic](u) [link](v) <b>bold</b> ~~gone~~")))
    assert got == "Head said one two three x = 1 | a | b | pic link bold gone"


def test_pages_follow_each_other(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", None), ("d", 5.0), ("e", 1.0), ("f", None)], "k string, t double")
    seen, cursor = [], ""
    for _ in range(5):
        p = query.page_object(df, "t", "k", cursor=cursor, limit=2).first()
        seen += p["keys"]
        if not p.has_more:
            break
        cursor = p.next_cursor
    assert seen == ["d", "a", "b", "e", "c", "f"] and p.next_cursor is None
    assert query.page_object(df, "t", "k", cursor="none", limit=0).first()["keys"] == ["d"]
    assert tuple(query.page_object(df.limit(0), "t", "k", cursor="a").first()) == ([], False, None)


def test_session_export(spark):
    about = spark.createDataFrame([("k1", "i1", "/p", "", "", "", "cli"), ("k2", "i2-long-long-id", "", "2026-01-02T15:04:05Z", "x", "s", "")], "k string, id string, cwd string, timestamp string, model_provider string, source string, originator string")
    said = spark.createDataFrame([("k1", i, "user" if i % 2 else None, t) for i, t in enumerate(["a", "bcd", None, "e", "f"])], "k string, n int, role string, text string")
    got = {r.k: (r.file_name, r.markdown) for r in export.export_session(about, said, Columns("k", ("n",), "role", "text"), most=3, max_chars=2).collect()}
    assert got["k1"] == ("session-i1.md", "# Session: /p\n\n- **Start Time**: Unknown time\n- **Provider**: unknown\n- **Source**: cli\n- **Session ID**: i1\n\n## unknown\n\na\n\n## user\n\nbc\n\nThis message is too large; only the first 2 characters are shown\n\n## system\n\n2 messages in the middle were omitted for safe display\n\n## unknown\n\nf\n")
    assert got["k2"] == ("session-i2-long-long.md", "# Session: i2-long-long-id\n\n- **Start Time**: Jan 2, 2026, 3:04:05 PM\n- **Provider**: x\n- **Source**: s\n- **Session ID**: i2-long-long-id\n")


def test_document_events_and_history(spark, tmp_path):
    (tmp_path / "sessions").mkdir()
    (tmp_path / "sessions" / "a.json").write_text(json.dumps({"sessionId": "a", "prompt": "go", "startedAt": 1767225600000}))
    (tmp_path / "sessions" / "b.json").write_text(json.dumps({"id": "b", "prompt": "no", "entries": []}))
    (tmp_path / "sessions" / "c.json").write_text(json.dumps({"prompt": "no id"}))
    rows = [json.dumps({"sessionId": "a", "display": " hi ", "timestamp": 1767225601000}), "", "{bad", json.dumps({"session_id": "b", "display": 5}), json.dumps({"sessionId": "z", "display": "else"})]
    (tmp_path / "history.jsonl").write_text("\n".join(rows) + "\n")
    docs, history = logs.read_documents(spark, [str(tmp_path / "sessions")], "claude_code"), logs.read_history(spark, [str(tmp_path / "history.jsonl")])
    got = sorted((r.id or "", r.type, r.line_number or 0, r.timestamp) for r in logs.document_events(docs, history).collect())
    assert got == [("", "parse_error", 2, None), ("", "parse_error", 3, None), ("a", "info", 0, "2026-01-01T00:00:00.000Z"), ("a", "user", 1, "2026-01-01T00:00:00.000Z"), ("a", "user_input", 1, "2026-01-01T00:00:01.000Z"), ("b", "info", 0, None), ("b", "user_input", 4, None)]
    assert {r.id: r.event_count for r in logs.document_event_counts(docs, history).collect()} == {"a": 5, "b": 4}
    assert [(r.id, r.text, r.role, r.source_subtype, r.synthetic_context) for r in logs.history_messages(docs, history).collect()] == [("a", "hi", "user", "display", False)]
    left = edit.redact_sessions(history, spark.createDataFrame([("a",)], "id string"), ["id"])
    assert sorted(r.line_number for r in left.collect()) == [2, 3, 4, 5]


def test_array_logs_lose_a_session(spark):
    files = lines(spark, [[{"sessionId": "a", "n": 1}, {"n": 2}, {"sessionId": "b", "n": 3}, {"sessionId": "a", "n": 4}, 7], [{"sessionId": "a", "n": 5}], [], {"sessionId": "a"}]).select(F.col("line_number").alias("file_path"), "record")
    out = {r.file_path: (r.n_removed, json.loads(r.j)) for r in edit.redact_array_logs(files, spark.createDataFrame([("a",), ("a",)], "id string")).select("*", F.to_json("record").alias("j")).collect()}
    assert out == {0: (2, [{"n": 2}, {"n": 3, "sessionId": "b"}, 7]), 1: (1, []), 2: (0, []), 3: (0, {"sessionId": "a"})}


def test_a_redacted_call_takes_its_results_along(spark):
    use = lambda *ids: {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": i, "name": "run", "input": {}} for i in ids]}}
    got = lambda *ids: {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": "x"} for i in ids]}}
    r = lines(spark, [use("a", "b"), got("a"), got("b", "c"), got("c"), {"type": "user", "message": {"content": "plain"}}, {"type": "user", "message": {"content": "plain too"}}, "{bad"])
    marks = {x.line_number: x.f for x in r.where("record IS NOT NULL").select("line_number", edit.entry_fingerprint(F.col("record")).alias("f")).collect()}
    refs = spark.createDataFrame([("f", 0, 1, marks[0]), ("f", 4, 0, marks[4]), ("f", 5, 0, "old"), ("f", 5, 3, marks[5])], "file_path string, line_number long, message_index int, fingerprint string")
    kept, stale = edit.redact_records(r, refs)
    assert sorted(x.line_number for x in kept.collect()) == [3, 5, 6]  # line 2 goes for its call b; its call c isn't followed
    assert sorted((x.line_number, x.message_index) for x in stale.collect()) == [(5, 0), (5, 3)]


def test_summaries_of_a_session_merge(spark):
    s = "id string, file_path string, timestamp string, last_timestamp string, cwd string, model_provider string, originator string, event_count long, message_count long, context_count long, role_counts map<string,bigint>, first_user string, first_assistant string, first_message string"
    rows = [
        ("s", "f2", "2026-01-01T02:00:00+02:00", "2026-01-01T09:00:00Z", "/late?", "unknown", "", 1, 1, 0, {"user": 1}, "second", "", "m"),
        ("s", "f1", "2026-01-01T01:00:00Z", "2026-01-01T10:30:00+02:00", "/last", "p", "o", 2, 1, 1, {"user": 2, "tool": 1}, "third", "a", "n"),
        ("s", "f0", "", "", "", "q", "", 4, 0, 0, {}, "", "", ""),
        ("t", "g1", "b", "b", "", "", "", 1, 0, 0, None, None, None, None), ("t", "g2", "2026-01-01T00:00:00Z", "", "/x", None, None, 1, 0, 0, {}, "u", None, None),
    ]
    got = {r.id: r for r in summary.merge_summaries(spark.createDataFrame(rows, s)).collect()}
    a, b = got["s"], got["t"]
    assert (a.file_path, a.timestamp, a.last_timestamp, a.cwd, a.model_provider, a.originator) == ("f2", "2026-01-01T02:00:00+02:00", "2026-01-01T09:00:00Z", "/last", "p", "o")
    assert (a.event_count, a.message_count, a.context_count, a.role_counts, a.first_user, a.first_assistant, a.first_message, a.files) == (7, 2, 1, {"user": 3, "tool": 1}, "second", "a", "m", 3)
    assert (b.file_path, b.timestamp, b.last_timestamp, b.cwd, b.model_provider, b.role_counts, b.first_user) == ("g2", "2026-01-01T00:00:00Z", "b", "/x", "unknown", {}, "u")
