import hashlib
import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import export, ordered, query
from threadloom.plans import files
from threadloom.plans.registry import CONV
from threadloom.sources import logs, shared, snapshots
from threadloom.streaming import refresh

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_snapshot_keeps_lines_and_their_order_over_many_parts(spark, tmp_path):
    rows = [("big", i, f"line {i}") for i in range(2000)] + [("a b/c.jsonl", 1, "x"), ("a b/c.jsonl", 2, ""), ("a b/c.jsonl", 3, None)]
    df = spark.createDataFrame(rows, "file_path string, line_number long, raw string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        snapshots.write_snapshot(df, str(tmp_path / "v1"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = snapshots.read_snapshot(spark, str(tmp_path / "v1"))
    assert sorted((r.file_path, r.line_number, r.raw) for r in back.collect()) == sorted([("big", i + 1, f"line {i}") for i in range(2000)] + [("a b/c.jsonl", 1, "x"), ("a b/c.jsonl", 2, "")])
    assert len(list((tmp_path / "v1" / "file_path=big").glob("part-*"))) > 1
    with pytest.raises(Exception, match="(?i)exists"):
        snapshots.write_snapshot(df, str(tmp_path / "v1"))


def test_lines_of_long_conversations_are_read_in_order(spark, tmp_path):
    # eight tasks that stay apart, and more than a hundred turns: a file is whole and in order all the same
    turns = [(conv, turn) for conv in range(60) for turn in range(130 if conv % 29 == 3 else 3)]
    spark.createDataFrame([(c, t, "user", "said") for c, t in turns], CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    lines: dict[str, list] = {}
    for c, t in turns:
        found = [(False, str(c), t)] + [(True, None, None)] * (t % 5 == 4) + [None] * (t % 7 == 6)
        lines.setdefault(f"b{c // 50}", []).extend(found)
    want = {(file, n + 1, *x) for file, found in lines.items() for n, x in enumerate(found) if x}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in files.read_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == want and len(got) == len(want)


def test_lines_are_numbered_over_the_splits_of_a_file(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("one\n\ntwo")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        read = logs.read_jsonl(spark, [str(tmp_path)], "codex")
        got = {(r.file_path[-7], r.line_number): r.raw for r in read.collect()}
        # one row a split is what meets by file; lines are joined where they lie
        assert got == {**{("a", i + 1): x for i, x in enumerate(lines)}, ("b", 1): "one", ("b", 3): "two"}
        assert read.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_roots_and_manifests(spark, tmp_path):
    assert logs.choose_root(spark, str(tmp_path)) == f"{tmp_path}/sessions"
    (tmp_path / "projects").mkdir()
    assert logs.choose_root(spark, f"{tmp_path}/") == f"{tmp_path}/projects"
    (tmp_path / "projects" / "a.jsonl").write_bytes(b"abc")
    (tmp_path / "projects" / "b.txt").write_bytes(b"")
    (row,) = logs.read_manifest(spark, [str(tmp_path)], "*.jsonl", hashes=True).collect()
    assert (row.file_size, row.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
    assert logs.read_manifest(spark, [str(tmp_path)]).where("sha256 IS NULL").count() == 1  # the empty file has no row


def test_an_index_of_another_parser_does_not_hold(spark):
    manifest = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    index = spark.createDataFrame([("a", 1, 7), ("b", 2, 6), ("c", 3, 7)], "path string, size long, parser_version int")
    fresh, held = refresh.reuse_index(manifest, index, ["path", "size"], parser_version=7)
    assert ([r.path for r in fresh.collect()], [r.path for r in held.collect()]) == (["b"], ["a"])
    fresh, held = refresh.reuse_index(manifest, index, ["path", "size"], parser_version=8)
    assert (fresh.count(), held.count()) == (2, 0)


def test_flags_days_and_null_archived(spark):
    df = spark.createDataFrame([(1, "2026-08-20T10:00:00Z", None, False), (2, None, True, False), (3, "2026-09-01T00:00:00Z", False, True)], "id long, timestamp string, archived boolean, hidden boolean")
    ids = lambda **k: [r.id for r in query.filter_sessions(df, **k).orderBy("id").collect()]
    assert ids() == [1] and ids(show_archived="1") == [1, 2] and ids(show_hidden="true") == [1, 3] and ids(show_hidden="True", show_archived="yes") == [1]
    assert ids(date="2026") == [1] and ids(date="2026-09", show_hidden=True) == [3] and ids(date="2026-08-2") == [1] and ids(date="2025") == []


def test_per_day_has_one_decimal(spark):
    df = spark.createDataFrame([(i, "a" if i < 4 else "b" if i < 7 else None) for i in range(9)], "n long, d string")
    assert query.stats_totals(df, F.col("n"), F.col("d")).first().per_day == "4.5"
    assert query.stats_totals(df.where("n = 0"), F.col("n"), F.col("d")).first().per_day == "1.0"
    assert query.stats_totals(df.where("n > 7"), F.col("n"), F.col("d")).first().per_day == "0"


def test_canonical_paths(spark):
    ways = {"/a/b": ["/a/b", "/a//b/", "file:///a/./b", "/a/c/../b", "/../a/b", "hdfs://a/b"], "/": ["/", "/..", ""], None: [None]}
    df = spark.createDataFrame([(w, k) for k, ws in ways.items() for w in ws], "p string, want string")
    assert df.select(T.canonical_path(F.col("p")).eqNullSafe(F.col("want")).alias("ok")).where("NOT ok").count() == 0


def test_exports_of_long_sessions(spark):
    rows = [(1, i, "user", "x" * (20_005 if i == 0 else 3)) for i in range(900)] + [(2, 0, "assistant", "y")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = messages.select("conv_id", "turn").unionByName(messages.select("conv_id", (F.col("turn") + 1000).alias("turn"))).where("conv_id = 1")
    about = spark.createDataFrame([(1, "one", "k"), (2, "two", "k"), (3, "three", "k")], "conv_id long, title string, _message_key string")
    got = {r.conv_id: json.loads(r.json) for r in export.export_json(messages, CONV, summaries=about, events=events, most_events=1200).collect()}
    assert (len(got[1]["messages"]), got[1]["omitted"], len(got[1]["messages"][0]["text"])) == (800, 100, 20_000)
    assert (len(got[1]["raw_events"]), got[1]["events_omitted"]) == (1200, 600)
    assert got[2]["summary"] == {"title": "two"} and "raw_events" not in got[2] and "messages" not in got[3]
    text = export.export_markdown(messages, CONV).where("conv_id = 1").first().markdown
    assert "_100 messages left out_" in text and text.count("## user") == 800


def test_search_document_is_cut_at_whole_characters(spark):
    messages = spark.createDataFrame([("k", i, "user", "é" * 40) for i in range(30)], "session_key string, line_number long, role string, text string")
    about = spark.createDataFrame([("k", "head é"), ("none", "h"), ("full", "ü" * 400)], "session_key string, head string")
    for cap in (500, 501, 502, 503):
        bodies = ordered.search_document(messages, export.Columns(), cap)
        got = {r.session_key: r.document for r in ordered.whole_search_document(about, bodies, F.col("head"), cap).collect()}
        body = b"".join(b"user\n" + "é".encode() * 40 + b"\n" for _ in range(30))
        want = ("head é".encode() + body[: cap - 7]).decode(errors="ignore") + "\n"
        assert got == {"k": want, "none": "h\n", "full": "ü" * 400}


def test_shared_folder_is_read_from_the_session(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    assert shared.new_path(spark, "x").startswith(shared.shared_dir(spark))


def test_what_was_written_can_be_forgotten(spark, tmp_path):
    before = shared.places()
    one, two = shared.new_path(spark, "one"), shared.new_path(spark, "two")
    for p in (one, two):
        spark.range(3).write.parquet(p)
    assert shared.forget(spark, keep={*before, two}) == 1
    assert spark.read.parquet(two).count() == 3 and shared.places() == {*before, two}
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(one).count()


def test_a_run_forgets_its_own_places_alone(spark):
    """Two runs at once, step by step: neither's clean-up touches what the other has written meanwhile."""
    import threading

    began, wrote, gone = threading.Event(), threading.Event(), threading.Event()
    found = {}

    def other():
        began.wait(60)
        with shared.run():
            path = shared.new_path(spark, "other")
            spark.range(3).write.parquet(path)
            wrote.set()
            gone.wait(60)
            found["rows"] = spark.read.parquet(path).count()
            found["forgot"] = shared.forget(spark)

    thread = threading.Thread(target=other)
    thread.start()
    outside = shared.new_path(spark, "outside")
    with shared.run():
        mine, result = shared.new_path(spark, "mine"), shared.new_path(spark, "result")
        for p in (mine, result):
            spark.range(2).write.parquet(p)
        began.set()
        wrote.wait(60)
        assert shared.places() == {mine, result} and shared.forget(spark, keep=[result]) == 1
        gone.set()
        thread.join(60)
    assert found == {"rows": 3, "forgot": 1}
    assert {outside, result} <= shared.places() and spark.read.parquet(result).count() == 2
