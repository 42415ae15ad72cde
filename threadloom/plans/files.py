"""Queries of readers, sinks and streams: the given tables are written as files to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import variants as V
from threadloom.operators import edit, normalize, ordered, query, search_index, summary
from threadloom.plans.registry import _t, says
from threadloom.sources import arrays, logs, shared, snapshots
from threadloom.streaming import refresh, store


def _bucket(c: str):
    return F.concat(F.lit("b"), F.floor(F.col(c) / 50).cast("string"))


def conversation_lines(spark, sf_dir) -> DataFrame:
    """conversations as lines of JSON, fifty to a file. Every fifth turn is followed by a line that is no JSON, every seventh
    by a blank one."""
    c = _t(spark, sf_dir, "conversations")
    said = F.to_json(F.struct(F.lit("message").alias("type"), F.col("conv_id").cast("string").alias("sessionId"), "turn", "role", "text"))
    lines = F.array_compact(F.array(said, F.when(F.col("turn") % 5 == 4, "{bad"), F.when(F.col("turn") % 7 == 6, "  ")))
    # a place, not a number: conversations may have any number of turns
    return c.select(_bucket("conv_id").alias("file_path"), "conv_id", "turn", F.posexplode(lines).alias("k", "raw")).select("file_path", F.struct("conv_id", "turn", "k").alias("line_number"), "raw")


_LINES = """WITH l AS (SELECT 'b' || conv_id // 50 AS file, conv_id, turn, 0 AS k, 'message' AS kind FROM conversations
 UNION ALL SELECT 'b' || conv_id // 50, conv_id, turn, 1, 'bad' FROM conversations WHERE turn % 5 = 4 UNION ALL SELECT 'b' || conv_id // 50, conv_id, turn, 2, 'blank' FROM conversations WHERE turn % 7 = 6),
 n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY conv_id, turn, k) AS line_number FROM l)
"""


def _write_files(lines: DataFrame, path: str) -> None:
    """Lines (file_path, line_number, raw) as one file each, below a directory of its name: read by itself, a file has all of
    its lines. Parts of a snapshot don't; they are for `read_snapshot`."""
    lines.repartition("file_path").sortWithinPartitions("file_path", "line_number").select("file_path", F.col("raw").alias("value")).write.partitionBy("file_path").text(path)


def _written(spark, sf_dir) -> str:
    path = shared.new_path(spark, "lines")
    snapshots.write_snapshot(conversation_lines(spark, sf_dir), path)
    return path


@says(_LINES + "SELECT file, line_number, kind = 'bad' AS bad, CASE WHEN kind = 'message' THEN conv_id::VARCHAR END AS session, CASE WHEN kind = 'message' THEN turn END AS turn FROM n WHERE kind <> 'blank'")
def read_lines(spark, sf_dir):
    """Files of lines, read as transcripts: numbered with blank lines counted, those that are no JSON without a record."""
    path = shared.new_path(spark, "lines")
    _write_files(conversation_lines(spark, sf_dir), path)
    r = F.col("record")
    out = logs.read_jsonl(spark, [path], "codex", glob="*.txt")
    bad = logs.parse_errors(out).select("file_path", "line_number", F.lit(True).alias("bad"))
    good = out.where("record IS NOT NULL").select("file_path", "line_number", F.lit(False).alias("bad"), V.string_at(r, "$.sessionId").alias("session"), F.try_variant_get(r, "$.turn", "bigint").alias("turn"))
    both = good.unionByName(bad, allowMissingColumns=True)
    return both.select(F.regexp_extract("file_path", r"file_path=([^/]+)", 1).alias("file"), "line_number", "bad", "session", "turn")


@says(_LINES + "SELECT file, row_number() OVER (PARTITION BY file ORDER BY conv_id, turn, k) AS line_number, conv_id, turn FROM n WHERE kind = 'message' AND conv_id % 10 <> 3")
def snapshot_lines(spark, sf_dir):
    """A corpus without every tenth conversation and without lines that are no JSON, written as a new version and read back."""
    lines = snapshots.read_snapshot(spark, _written(spark, sf_dir)).withColumn("record", F.try_parse_json("raw")).where("record IS NOT NULL")
    gone = _t(spark, sf_dir, "conversations").where("conv_id % 10 = 3").select(F.col("conv_id").cast("string").alias("session"))
    left = edit.redact_sessions(lines.withColumn("session", V.string_at(F.col("record"), "$.sessionId")), gone, ["session"])
    path = shared.new_path(spark, "snapshot")
    snapshots.write_snapshot(left, path)
    r = F.try_parse_json("raw")
    return snapshots.read_snapshot(spark, path).select(F.col("file_path").alias("file"), "line_number", V.string_at(r, "$.sessionId").cast("long").alias("conv_id"), F.try_variant_get(r, "$.turn", "bigint").alias("turn"))


@says("""WITH e AS (SELECT conv_id // 50 AS b, conv_id, turn, text, row_number() OVER (PARTITION BY conv_id // 50 ORDER BY conv_id, turn) - 1 AS line_number FROM conversations)
SELECT '/logs/b' || b AS file_path, line_number, conv_id::VARCHAR AS id, turn FROM e WHERE turn % 4 <> 3 AND turn % 4 <> 2""")
def array_log_elements(spark, sf_dir):
    """Fifty conversations to an array log, read by ranges; of each four turns one names its session by a number, one names
    none."""
    own = F.when(F.col("turn") % 4 == 2, F.col("conv_id").cast("variant")).when(F.col("turn") % 4 < 2, F.col("conv_id").cast("string").cast("variant"))
    record = F.to_variant_object(F.struct(own.alias("sessionId"), F.col("turn")))
    path = shared.new_path(spark, "arrays")
    _write_files(snapshots.array_lines(_elements(spark, sf_dir, record)), path)
    found = arrays.of_sessions(arrays.array_elements(arrays.scan_arrays(spark, [path], "*.txt")))
    name = F.concat(F.lit("/logs/"), F.regexp_extract("file_path", r"file_path=([^/]+)", 1))
    return found.select(name.alias("file_path"), "line_number", "id", F.try_variant_get("record", "$.turn", "bigint").alias("turn"))


def _elements(spark, sf_dir, record) -> DataFrame:
    """Turns as elements of array logs, fifty conversations to a log, numbered in their order: a turn that is there twice has
    two places."""
    c = _t(spark, sf_dir, "conversations").select(_bucket("conv_id").alias("file_path"), "conv_id", "turn", record.alias("record"))
    return ordered.numbered(c, ["file_path"], ["conv_id", "turn"]).select("file_path", F.col("ord").alias("line_number"), "record")


@says("""WITH h AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_id % 3 AS batch FROM events)
SELECT event_id, 'k' || event_id AS session_key, batch = 2 AS second FROM h""")
def change_feed(spark, sf_dir):
    """Events land as files in two bursts; each is one refresh of the store, and the second changes what the first had of it."""
    ev = _t(spark, sf_dir, "events")
    landing, place = shared.new_path(spark, "landing"), shared.new_path(spark, "store")
    rows = ev.select("event_id", F.concat(F.lit("/e/"), F.col("event_id").cast("string")).alias("file_path"))
    summarize = lambda second: lambda df: df.select("event_id", "file_path", F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("session_key"), F.lit(second).alias("second"))
    feed = shared.new_path(spark, "feed")
    for n, burst in enumerate(("true", "event_id % 3 = 2")):
        rows.where(burst).write.mode("append").parquet(landing)
        q = refresh.start_refresh_stream(spark, landing, "event_id long, file_path string", refresh.refresh_store(place, summarize(bool(n)), buckets=16), checkpoint=feed, interval="0 seconds")
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return store.read(spark, place).select("event_id", "session_key", "second")


@says("SELECT DISTINCT conv_id, 'session-' || conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'one' ELSE 'two' END AS root FROM conversations")
def first_session_wins(spark, sf_dir):
    """Two roots that both have the odd conversations; even ones are in the first, and a copy of them in a later root."""
    c = _t(spark, sf_dir, "conversations").select("conv_id").distinct()
    own = lambda df, name: df.select("conv_id", F.concat(F.lit("codex:"), F.col("conv_id").cast("string")).alias("session_key"), F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("id"), F.lit(name).alias("root"), F.lit(name).alias("file_path"), F.create_map(F.lit("user"), F.lit(1)).alias("role_counts"))
    union = summary.union_sources([own(c.where("conv_id % 2 = 0"), "one"), own(c.where("conv_id % 2 = 1"), "two"), own(c, "three")])
    return summary.first_session_wins(union).select("conv_id", "id", "root")


@says("""SELECT '/c/' || o_custkey || '/' || o_orderkey // 4 AS place, min(o_orderkey % 3) AS root_rank, count(DISTINCT 1) AS files FROM orders GROUP BY 1""")
def first_root_of_file(spark, sf_dir):
    """Files of orders under three roots, whose paths are written in as many ways."""
    o = _t(spark, sf_dir, "orders")
    a, b = F.col("o_custkey").cast("string"), F.floor(F.col("o_orderkey") / 4).cast("string")
    way = F.col("o_orderkey") % 3
    path = F.when(way == 0, F.concat(F.lit("file:///c/"), a, F.lit("/"), b)).when(way == 1, F.concat(F.lit("/c//./"), a, F.lit("/x/../"), b)).otherwise(F.concat(F.lit("/c/"), a, F.lit("/"), b, F.lit("/")))
    one = query.first_root_of_file(o.select(path.alias("file_path"), way.alias("root_rank")))
    return one.groupBy(T.canonical_path(F.col("file_path")).alias("place")).agg(F.min("root_rank").alias("root_rank"), F.count(F.lit(1)).alias("files"))


@says("""WITH s AS (SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS archived, o_orderpriority = '1-URGENT' AS hidden FROM orders)
SELECT 'day' AS request, o_orderkey FROM s WHERE starts_with(day, '1995-0') AND NOT coalesce(archived, false) AND NOT hidden
UNION ALL SELECT 'archived', o_orderkey FROM s WHERE NOT hidden UNION ALL SELECT 'hidden', o_orderkey FROM s WHERE NOT coalesce(archived, false) UNION ALL SELECT 'yes', o_orderkey FROM s WHERE NOT hidden AND NOT coalesce(archived, false)""")
def filter_requests(spark, sf_dir):
    """Four requests: a day prefix; archived ones shown; hidden ones shown; and a flag that says neither 1 nor true."""
    s = _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" (no time)")).alias("timestamp"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("archived"), (F.col("o_orderpriority") == "1-URGENT").alias("hidden"),
    )
    requests = {"day": {"date": "1995-0"}, "archived": {"show_archived": "true"}, "hidden": {"show_hidden": "1"}, "yes": {"show_archived": "yes", "show_hidden": "0"}}
    found = [query.filter_sessions(s, **r).select(F.lit(name).alias("request"), "o_orderkey") for name, r in requests.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@says("SELECT '/c/' || o_custkey AS path, count(*) AS count, max(o_orderdate::DATE::VARCHAR) AS last_timestamp FROM orders GROUP BY o_custkey ORDER BY last_timestamp DESC, path LIMIT 4")
def newest_projects(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("cwd"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.col("o_orderpriority").alias("model_provider"), F.col("o_orderstatus").alias("source_kind"))
    return query.newest_projects(query.project_list(o)).select("path", "count", "last_timestamp")


@says("""WITH p AS (SELECT source, doc_id, 0 AS k, 'user' AS v FROM documents UNION ALL SELECT source, doc_id, 1, coalesce(text, '') FROM documents),
 r AS (SELECT *, coalesce(sum(octet_length(encode(v)) + 1) OVER (PARTITION BY source ORDER BY doc_id, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM p),
 c AS (SELECT source, doc_id, k, v, 64000 - before AS room FROM r WHERE before < 64000),
 cut AS (SELECT source, doc_id, k, CASE WHEN octet_length(encode(v)) <= room THEN v ELSE left(v, list_max(list_filter(range(room - (octet_length(encode(v)) - length(v)), room + 1), lambda n: octet_length(encode(left(v, n))) <= room))) END AS v FROM c),
 b AS (SELECT source, string_agg(v || chr(10), '' ORDER BY doc_id, k) AS body FROM cut GROUP BY source),
 h AS (SELECT source, concat_ws(chr(10), source, 'codex:' || source, 'title', '/p', 'codex') AS head, body FROM b),
 w AS (SELECT source, head, body, 64000 - octet_length(encode(head)) AS room FROM h)
SELECT source, md5(head || CASE WHEN octet_length(encode(body)) <= room THEN body ELSE left(body, list_max(list_filter(range(room - (octet_length(encode(body)) - length(body)), room + 1), lambda n: octet_length(encode(left(body, n))) <= room))) END || chr(10)) AS document_md5 FROM w""")
def search_document_whole(spark, sf_dir):
    """Documents of a source as messages of one session: the head of its summary, then what fits 64,000 bytes."""
    d = _t(spark, sf_dir, "documents")
    messages = d.select(F.concat(F.lit("codex:"), F.col("source")).alias("session_key"), F.col("doc_id").alias("line_number"), F.lit("user").alias("role"), "text", F.lit(False).alias("synthetic_context"))
    bodies = ordered.search_document(messages.where("NOT synthetic_context"), normalize.Columns(), 64_000)
    null = F.lit(None).cast("string")
    own = {"id": F.col("source"), "session_key": F.concat(F.lit("codex:"), F.col("source")), "title": F.lit("title"), "preview_text": null, "cwd": F.lit("/p"), "file_path": null, "source_kind": F.lit("codex"), "display_source": null, "model_provider": null, "source": null, "originator": null}
    about = d.select("source").distinct().select(*(c.alias(k) for k, c in own.items()))
    out = ordered.whole_search_document(about, bodies, summary.search_head(), 64_000)
    return out.select(F.substring("session_key", 7, 100).alias("source"), F.md5("document").alias("document_md5"))


@says("""WITH c AS (SELECT doc_id, text, list_max(list_filter(range(0, 102), lambda n: octet_length(encode(left(text, n))) <= 101)) AS n FROM documents)
SELECT doc_id, left(text, n) || CASE WHEN octet_length(encode(left(text, n))) < least(101, octet_length(encode(text))) THEN chr(65533) ELSE '' END AS shown FROM c""")
def lossy_text(spark, sf_dir):
    """Texts as bytes that end after 101 of them, inside a character or not."""
    return _t(spark, sf_dir, "documents").select("doc_id", T.lossy_text(F.substring(F.encode("text", "UTF-8"), 1, 101)).alias("shown"))


def _plan(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    raw = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("model_provider")).alias("payload")))
    records = o.select(F.col("o_custkey").cast("string").alias("file_path"), F.col("o_orderkey").alias("line_number"), F.parse_json(raw).alias("record"))
    return records, edit.plan_relabel(logs.scan_assignments(records), ["5-LOW"], "new")


@says("""SELECT o_custkey::VARCHAR AS path, o_orderkey AS line_number, o_orderkey::VARCHAR AS session_id, '5-LOW' AS old, 'new' AS new, sha256('{"payload":{"id":"' || o_orderkey || '","model_provider":"5-LOW"},"type":"session_meta"}') AS record_sha256,
 sha256('file ' || o_custkey) AS file_sha256 FROM orders WHERE o_orderpriority = '5-LOW'""")
def before_image(spark, sf_dir):
    """What a relabelling keeps of the lines that it changes, with hashes of lines and files."""
    records, plan = _plan(spark, sf_dir)
    manifest = records.select("file_path").distinct().withColumn("sha256", F.sha2(F.concat(F.lit("file "), "file_path"), 256))
    return edit.before_image(records, plan, manifest)


_MAPPED = """WITH a AS (SELECT substr(o_orderpriority, 3, 20) AS provider FROM orders), t AS (SELECT c_mktsegment AS provider FROM customer),
 c AS (SELECT provider, count(*) FILTER (k = 't') AS threads, count(*) FILTER (k = 'a') AS jsonl FROM (SELECT provider, 'a' AS k FROM a UNION ALL SELECT provider, 't' FROM t) GROUP BY provider)
"""


@says(_MAPPED + "SELECT provider AS source, 'URGENT' AS target, threads, jsonl, provider IN ('LOW', 'HIGH') AS selected FROM c WHERE regexp_full_match(provider, '[A-Za-z0-9_.:-]{1,128}') AND provider <> 'URGENT'")
def relabel_mappings(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    a = o.select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("line_number"), F.substring("o_orderpriority", 3, 20).alias("provider"))
    return edit.relabel_mappings(a, c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("provider")), ["HIGH", "LOW"], "URGENT")


@says("""SELECT 'same' AS change, true AS holds FROM (SELECT count(*) FROM orders) UNION ALL SELECT 'a line more', false FROM (SELECT count(*) FROM orders) UNION ALL SELECT 'another choice', false FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'a label changed', NOT bool_or(o_orderkey = (SELECT max(o_orderkey) FROM orders)) FROM orders""")
def plan_holds(spark, sf_dir):
    """Whether a plan still holds: for the same lines, after one more, after one changed, and for another choice."""
    records, _ = _plan(spark, sf_dir)
    # lines are parsed once, not for each field and again for each plan; every plan is checked against what was found in them
    a = shared.kept(logs.scan_assignments(shared.kept(records, "records")), "assignments")
    threads = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("provider"))
    plan = spark.createDataFrame([(edit.plan_fingerprint(a, threads, ["5-LOW"], "new").first()[0],)], "plan_id string")
    last = a.agg(F.max("line_number").alias("_last"))
    more = a.unionByName(a.limit(1).withColumn("line_number", F.lit(-1).cast("long")))
    other = a.crossJoin(F.broadcast(last)).withColumn("provider", F.when(F.col("line_number") == F.col("_last"), "other").otherwise(F.col("provider"))).drop("_last")  # one row
    rows = [("same", a, ["5-LOW"]), ("a line more", more, ["5-LOW"]), ("a label changed", other, ["5-LOW"]), ("another choice", a, ["1-URGENT"])]
    found = [edit.plan_holds(plan, df, threads, chosen, "new").select(F.lit(name).alias("change"), "holds") for name, df, chosen in rows]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@says("""SELECT conv_id, count(*) AS message_count, sum(('0x' || substr(md5(turn || ':' || text), 1, 8))::BIGINT)::BIGINT AS texts FROM conversations WHERE turn % 5 <> 4 GROUP BY 1""")
def documents_snapshot(spark, sf_dir):
    """Conversations as array logs without every fifth turn, written as documents of a new version and read back."""
    turn = F.struct(F.col("conv_id").cast("string").alias("sessionId"), "turn", "text")
    every = _elements(spark, sf_dir, F.to_variant_object(turn))
    left = every.where(F.try_variant_get("record", "$.turn", "bigint") % 5 != 4)
    path = shared.new_path(spark, "documents")
    snapshots.write_array_logs(left, path, every)
    back = arrays.of_sessions(snapshots.read_array_logs(spark, path))
    text = F.concat_ws(":", F.try_variant_get("record", "$.turn", "string"), V.string_at(F.col("record"), "$.text"))
    share = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return back.groupBy(F.col("id").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("message_count"), F.sum(share).alias("texts"))


@says("""SELECT doc_id, 'apache license' AS asked FROM documents WHERE contains(lower(text), 'apache') AND contains(lower(text), 'license')
UNION ALL SELECT doc_id, 'The TION' FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')
UNION ALL SELECT doc_id, 'ße de' FROM documents WHERE contains(lower(text), 'ße') AND contains(lower(text), 'de')""")
def search_indexed(spark, sf_dir):
    """Documents in an index of at most 32 parts, searched for rare terms, frequent ones and ones too short for signatures."""
    path = shared.new_path(spark, "search")
    search_index.write_index(_t(spark, sf_dir, "documents"), path, key="doc_id", text="text", parts=32)
    found = [search_index.search(spark, path, asked, text="text", with_snippet=False).select("doc_id", F.lit(asked).alias("asked")) for asked in ("apache license", "The TION", "ße de")]
    return found[0].unionByName(found[1]).unionByName(found[2])
