import json

from pyspark.sql import functions as F

from threadloom.functions import variants as V
from threadloom.operators import edit, normalize, summary
from threadloom.sources import logs
from threadloom.streaming import refresh
from threadloom.streaming import store as stores


def records(spark, rows, path="f.jsonl"):
    df = spark.createDataFrame([(path, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "file_path string, line_number long, raw string")
    return df.withColumn("record", F.try_parse_json("raw"))


def test_blocks_calls_results_and_context(spark):
    r = records(spark, [
        {"type": "user", "sessionId": "s", "message": {"content": "  hi "}},
        {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t", "name": "run", "input": {"a": 1}}, 7, " "]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"text": "ok"}, {"content": [{"text": "deep"}]}], "is_error": True}, {"type": "tool_result", "content": None}]}},
        {"type": "result", "subtype": "error_max", "result": "bad"},
        {"type": "user", "isMeta": True, "message": {"content": "x"}},
        {"type": "user", "message": {"content": "# AGENTS.md instructions"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "sh", "call_id": "c", "arguments": "{}"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "out"}},
        {"type": "user", "message": {"content": None}}, 5, "{bad",
    ])
    got = [(m.line_number, m.message_index, m.role, m.text, m.synthetic_context, m.tool_name, m.is_error) for m in normalize.normalize(r).orderBy("ord").collect()]
    assert got == [
        (0, 0, "user", "hi", False, None, False), (1, 0, "assistant", "hm", True, None, False), (1, 1, "tool", '[run] {"a":1}', False, "run", False),
        (2, 0, "tool", "ok\n\ndeep", False, "run", True), (2, 1, "tool", "null", False, "tool_result", False), (3, 0, "system", "bad", False, None, True),
        (4, 0, "user", "x", True, None, False), (5, 0, "user", "# AGENTS.md instructions", True, None, False), (6, 0, "tool", "{}", False, "sh", False), (7, 0, "tool", "out", False, "sh", False),
    ]
    assert [e.type for e in normalize.events(r).orderBy("line_number").collect()][-2:] == ["unknown", "parse_error"]
    one = summary.summarize_records(r, normalize.normalize(r)).first()
    assert (one.id, one.event_count, one.message_count, one.context_count, one.tool_count, one.title) == ("s", 10, 7, 3, 5, "hi")


def test_a_number_is_no_string(spark):
    v = F.parse_json(F.lit('{"a": 1, "b": "1", "c": null, "d": true}'))
    got = spark.range(1).select(V.string_at(v, "$.a"), V.string_at(v, "$.b"), V.string_at(v, "$.c"), V.string_at(v, "$.e"), V.true_at(v, "$.d"), V.true_at(v, "$.b")).first()
    assert tuple(got) == (None, "1", None, None, True, False)


def test_working_directory_against_a_loop(spark):
    import random

    rng, want, rows = random.Random(4), {}, []
    for f in range(60):
        cwd = ""
        for i in range(6):
            r = {k: rng.choice(["", "/a", "/b", "/c"]) for k in rng.sample(["cwd", "workspace", "project_root", "workingDirectory"], rng.randrange(3))}
            cwd = r.get("cwd", cwd)
            for k in summary.OTHER_CWD:
                cwd = cwd or r.get(k, "")
            rows.append((f"{f}", i, json.dumps(r)))
        want[f"{f}"] = cwd
    df = spark.createDataFrame(rows, "file_path string, line_number long, raw string").withColumn("record", F.try_parse_json("raw"))
    assert {r.file_path: r.cwd for r in summary.record_facts(df).collect()} == want


def test_subagents_are_hidden_and_find_their_parent(spark):
    a = records(spark, [{"type": "user", "sessionId": "p", "message": {"content": "go"}}], "/r/p.jsonl")
    b = records(spark, [{"type": "user", "sessionId": "p", "agentId": "x", "isSidechain": True, "message": {"content": "sub"}}], "/r/subagents/q.jsonl")
    r = a.unionByName(b)
    s = summary.summarize_records(r, normalize.normalize(r))
    assert sorted((x.id, x.hidden, x.source) for x in s.collect()) == [("p", False, "cli"), ("p:subagent:x", True, "subagent")]
    assert [tuple(x) for x in summary.link_parents(s).collect()] == [("codex:p:subagent:x", "codex:p")]
    twice = summary.union_sources([s.drop("root_rank"), s.drop("root_rank")])
    assert summary.first_session_wins(twice).count() == 2


def test_session_documents_and_history(spark, tmp_path):
    (tmp_path / "sessions").mkdir()
    (tmp_path / "sessions/a.json").write_text(json.dumps({"sessionId": "a", "startedAt": 1767225600000, "prompt": "first"}))
    (tmp_path / "sessions/b.json").write_text(json.dumps({"id": "b", "entries": [{"type": "user", "message": {"content": "one"}}]}))
    (tmp_path / "sessions/none.json").write_text("{}")
    (tmp_path / "history.jsonl").write_text('{"sessionId":"b","timestamp":1767225601000,"display":"more"}\n\n{"session_id":"b","timestamp":"later"}\n')
    docs = logs.read_documents(spark, [str(tmp_path / "sessions")], "claude_code")
    got = sorted((m.file_path[-6:], m.text) for m in normalize.normalize(logs.document_records(docs)).collect())
    assert got == [("a.json", "first"), ("b.json", "one")]
    history = logs.read_history(spark, [str(tmp_path / "history.jsonl")])
    assert sorted((h.line_number, h.parse_error) for h in history.collect()) == [(1, False), (2, True), (3, False)]
    rich = {r.id: (r.timestamp, r.last_timestamp, r.history_events, r.history_messages) for r in summary.enrich_history(docs, history).collect()}
    assert rich == {"a": ("2026-01-01T00:00:00.000Z", "2026-01-01T00:00:00.000Z", 0, 0), "b": ("2026-01-01T00:00:01.000Z", "later", 2, 1)}


def test_artifacts_and_their_deletion(spark, tmp_path):
    d = tmp_path / "antigravity/brain/s1"
    d.mkdir(parents=True)
    for name, text in {"plan": " ask ", "plan.metadata.json": '{"updatedAt": 1767225600000}', "plan.resolved": "yes", "plan.resolved.0": "more", "plan.resolved.2": "lost", "uploaded_x": "u", "blank": " "}.items():
        (d / name).write_text(text)
    got = sorted((r.name, r.part, r.role, r.text, r.timestamp) for r in logs.read_artifacts(spark, [str(tmp_path)]).collect())
    assert got == [("plan", -1, "user", "ask", "2026-01-01T00:00:00.000Z"), ("plan", 0, "assistant", "yes", ""), ("plan", 1, "assistant", "more", "")]
    files = spark.createDataFrame([("s", "a", "x"), ("s", "b", "y")], "session string, name string, content string")
    refs = files.withColumn("fingerprint", F.when(F.col("name") == "a", F.sha2("content", 256)).otherwise("stale"))
    assert [r.name for r in edit.redact_artifacts(files, refs).collect()] == ["b"]


def test_stale_entry_references_come_back(spark):
    docs = records(spark, [{"sessionId": "s", "entries": [{"a": 1}, {"b": 2}]}])
    prints = docs.select("file_path", F.posexplode(F.try_variant_get("record", "$.entries", "array<variant>")).alias("entry_index", "e")).select("file_path", "entry_index", edit.entry_fingerprint(F.col("e")).alias("fingerprint"))
    refs = prints.withColumn("fingerprint", F.when(F.col("entry_index") == 0, F.col("fingerprint")).otherwise("old"))
    kept, stale = edit.redact_entries(docs, refs)
    assert json.loads(kept.select(F.to_json("record")).first()[0]) == {"sessionId": "s", "entries": [{"b": 2}]}
    assert [r.entry_index for r in stale.collect()] == [1]


def test_relabel_preview_names_what_is_in_the_way(spark):
    a = spark.createDataFrame([("f", 1, "old"), ("f", 2, "bad one")], "path string, line_number long, provider string")
    t = spark.createDataFrame([("1", "old"), ("2", "openai")], "id string, provider string")
    p = edit.preview_relabel(a, t, [], "new").first()
    assert (p.candidates, p.blockers, p.can_apply, p.selection_required) == (1, "invalid_provider_id,source_provider_selection_required", False, True)
    good = a.where("line_number = 1")
    p = edit.preview_relabel(good, t, ["old"], "new").first()
    assert (p.files_to_change, p.replacements, p.thread_matches, p.can_apply, p.has_changes) == (1, 1, 1, True, True)
    edit.check_plan(p.plan_id, good, t, ["old"], "new")
    for wrong in (lambda: edit.check_plan(p.plan_id, a, t, ["old"], "new"), lambda: edit.select_providers("openai", "new"), lambda: edit.select_providers("a b", "new")):
        try:
            wrong()
        except ValueError:
            continue
        raise AssertionError
    for target, code in (("openai", "active_provider_builtin"), ("", "active_provider_missing"), ("a b", "active_provider_invalid")):
        refused = edit.preview_relabel(good, t, ["old"], target).first()
        assert (refused.blockers, refused.warnings, refused.mappings) == (code, "", "[]")
    assert edit.preview_relabel(good, t.where("false"), ["old"], "new").first().warnings == "current_provider_only,codex_state_db_missing"


def test_stream_turns_landed_files_into_store_versions(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "file_path string, line_number long, raw string"

    def summarize(batch):
        r = batch.withColumn("record", F.try_parse_json("raw"))
        return summary.summarize_records(r, normalize.normalize(r)).select("file_path", "session_key", "message_count")

    line = lambda text: json.dumps({"type": "user", "message": {"content": text}})
    for n, rows in enumerate([[("a", 1, line("x")), ("b", 1, line("y"))], [("a", 1, line("x")), ("a", 2, line("z"))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = refresh.start_refresh_stream(spark, src, schema, refresh.refresh_store(store, summarize), checkpoint=str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        got = {r.file_path: r.message_count for r in stores.read(spark, store, n).collect()}
        assert got == ({"a": 1, "b": 1} if n == 0 else {"a": 2, "b": 1})


def test_record_facts_do_not_depend_on_runs(spark, monkeypatch):
    import random

    from threadloom.operators import summary

    rng = random.Random(4)
    rows, want = [], {}
    for f in range(60):
        cwd, provider = "", "unknown"
        for line in range(1, rng.randrange(2, 14)):
            r = {"type": "event"}
            if rng.random() < 0.3:
                r["cwd"] = cwd = rng.choice(["", "", f"/d{line}"])
            if rng.random() < 0.4:
                r["workspace"] = rng.choice(["", f"/w{line}"])
                cwd = cwd or r["workspace"]
            if rng.random() < 0.3:
                r["provider"] = provider = f"p{line}"
            rows.append((f"/f{f}", line, json.dumps(r)))
        want[f"/f{f}"] = (line, cwd, provider)
    records = spark.createDataFrame(rows, "file_path string, line_number long, raw string").withColumn("record", F.parse_json("raw"))
    for lines in (3, 4096):
        monkeypatch.setattr(summary, "RUN_LINES", lines)
        got = {r.file_path: (r.event_count, r.cwd, r.model_provider) for r in summary.record_facts(records).collect()}
        assert got == want
