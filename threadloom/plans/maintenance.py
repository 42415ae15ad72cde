"""Queries of relabelling, rollback, deletion and roots: what a write must find as it was planned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import variants as V
from threadloom.operators import edit, normalize, ordered, summary
from threadloom.plans.files import conversation_lines
from threadloom.plans.registry import CONV, EVENTS, _t, says
from threadloom.sources import logs, shared


def _threads(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("provider"))


@says("SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'new' ELSE c_mktsegment END AS provider FROM customer")
def relabel_planned_threads(spark, sf_dir):
    """Customers as threads, changed by a plan that was made of them."""
    threads = _threads(spark, sf_dir)
    return edit.apply_threads(threads, edit.plan_threads(threads, ["BUILDING", "MACHINERY"], "new"))


@says("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'late' WHEN c_custkey % 7 = 0 AND c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS provider,
 c_mktsegment = 'BUILDING' AND (c_custkey % 5 = 0 OR c_custkey % 7 = 0) AS conflict FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 <> 0 OR c_mktsegment = 'BUILDING'""")
def rollback_threads(spark, sf_dir):
    """A relabelling of threads undone; every fifth thread has changed since, every seventh of the others is gone."""
    threads = _threads(spark, sf_dir)
    plan = edit.plan_threads(threads, ["BUILDING"], "new")
    late = edit.apply_threads(threads, plan).withColumn("provider", F.when(F.col("id") % 5 == 0, "late").otherwise(F.col("provider")))
    return edit.rollback_threads(late.where("id % 5 = 0 OR id % 7 <> 0"), plan)


@says("SELECT o_custkey::VARCHAR AS file_path, o_orderkey AS line_number, o_orderpriority AS provider FROM orders")
def restore_records(spark, sf_dir):
    """Orders as records, relabelled, then restored from the before-image and a backup that still is what it says."""
    o = _t(spark, sf_dir, "orders")
    payload = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("model_provider"))
    record = F.to_variant_object(F.struct(F.lit("session_meta").alias("type"), payload.alias("payload")))
    records = o.select(F.col("o_custkey").cast("string").alias("file_path"), F.col("o_orderkey").alias("line_number"), record.alias("record"))
    plan = shared.kept(edit.plan_relabel(logs.scan_assignments(records), ["5-LOW", "1-URGENT"], "new"), "plan")
    back = edit.restore_records(edit.relabel_records(records, plan), edit.before_image(records, plan), records)
    return back.select("file_path", "line_number", V.string_at(F.col("record"), "$.payload.model_provider").alias("provider"))


@says("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '{"message":"kept"}' WHEN turn % 4 = 1 THEN '{"id":' || conv_id || '}' WHEN turn % 4 = 2 THEN '{"id":' || conv_id || ',"prompt":"p' || turn || '"}' ELSE '{"id":' || conv_id || ',"prompt":null}' END AS json,
 turn % 4 >= 2 AS stale FROM conversations""")
def redact_prompts(spark, sf_dir):
    """Turns as session documents: with a prompt and a message, with a message alone, with a prompt that has changed, and with
    a null prompt; all prompts are to go."""
    c = _t(spark, sf_dir, "conversations")
    kind, own = F.col("turn") % 4, F.concat(F.lit('{"id":'), F.col("conv_id").cast("string"))
    said = F.concat(F.lit('"p'), F.col("turn").cast("string"), F.lit('"'))
    json = F.when(kind == 0, F.concat(F.lit('{"message":"kept","prompt":'), said, F.lit("}"))).when(kind == 1, F.concat(own, F.lit(',"message":'), said, F.lit("}")))
    json = json.when(kind == 2, F.concat(own, F.lit(',"prompt":'), said, F.lit("}"))).otherwise(F.concat(own, F.lit(',"prompt":null}')))
    place = F.concat_ws("/", "conv_id", "turn")
    docs = c.select("conv_id", "turn", place.alias("file_path"), F.parse_json(json).alias("record"))
    seen = F.when(kind == 2, F.concat(F.lit('"q'), F.col("turn").cast("string"), F.lit('"'))).otherwise(said)
    refs = c.select("conv_id", "turn", place.alias("file_path"), edit.entry_fingerprint(F.parse_json(seen)).alias("fingerprint"))
    left, stale = edit.redact_prompts(docs, refs)
    marks = stale.select("file_path", F.lit(True).alias("stale"))
    return left.join(marks, "file_path", "left").select("conv_id", "turn", F.to_json("record").alias("json"), F.coalesce("stale", F.lit(False)).alias("stale"))


@says("""WITH p AS (SELECT source, doc_id, octet_length(encode(text)) + 1 AS n, text FROM documents),
 r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM p),
 c AS (SELECT source, doc_id, CASE WHEN n - 1 <= 20000 - before THEN text ELSE left(text, list_max(list_filter(range(20000 - before - (n - 1 - length(text)), 20001 - before), lambda k: octet_length(encode(left(text, k::INT))) <= 20000 - before))::INT) END AS t FROM r WHERE before < 20000)
SELECT source AS id, md5(string_agg(t || chr(10), '' ORDER BY doc_id DESC)) AS text_md5 FROM c GROUP BY source""")
def merge_search_texts(spark, sf_dir):
    """Documents of a source as the parts of a session, the last of them the earliest; 20,000 bytes of their texts stay."""
    d = _t(spark, sf_dir, "documents")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) - F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = d.select(F.col("source").alias("id"), F.col("doc_id").cast("string").alias("file_path"), stamp.alias("timestamp"), stamp.alias("last_timestamp"), F.col("text").alias("search_text"))
    return summary.merge_search_texts(parts, 20_000).select("id", F.md5("search_text").alias("text_md5"))


@says("""WITH e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_number, strlen('{"text":' || to_json(text) || ',"type":"user"}') AS bytes, length('{"text":' || to_json(text) || ',"type":"user"}') AS n FROM conversations)
SELECT conv_id::VARCHAR AS file_path, line_number, 'user' AS type, n > 300 AS payload_truncated, CASE WHEN n > 300 THEN n END AS original_chars FROM e""")
def array_log_events(spark, sf_dir):
    """Turns as elements of arrays, which have no lines: they are as long as their JSON."""
    c = _t(spark, sf_dir, "conversations")
    record = F.parse_json(F.to_json(F.struct(F.lit("user").alias("type"), "text")))
    elements = ordered.numbered(c.select(F.col("conv_id").cast("string").alias("file_path"), "turn", record.alias("record")), ["file_path"], ["turn"])
    events = normalize.events(elements.select("file_path", (F.col("ord") - 1).alias("line_number"), "record"), 300)
    return events.select("file_path", "line_number", "type", "payload_truncated", "original_chars")


@says("""WITH o AS (SELECT conv_id, turn, role, row_number() OVER w AS ord, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, ord, role, NULL::BIGINT AS omitted_count FROM o WHERE ord <= 3 OR ord > total - 2 UNION ALL SELECT DISTINCT conv_id, 4, 'system', total - 5 FROM o WHERE total > 5""")
def omitted_messages(spark, sf_dir):
    """Five messages of every conversation, and a row that stands for the others."""
    shown = ordered.head_tail(_t(spark, sf_dir, "conversations"), CONV, 5)
    marked = ordered.mark_omitted(shown, CONV, 5, {"role": F.lit("system"), "text": F.lit("")})
    return marked.select("conv_id", "ord", "role", "omitted_count")


@says("""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, count(*) OVER (PARTITION BY user_id) AS seen FROM events),
 t AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN seen + 3 ELSE 1 END AS counted FROM e)
SELECT event_id, ord, greatest(seen, counted) AS total, greatest(seen, counted) - least(seen, 8) AS omitted FROM t WHERE ord <= 4 OR ord > seen - 4""")
def counted_records(spark, sf_dir):
    """Eight records of every user; the summaries of even users have counted three more than there are now, others one."""
    ev = _t(spark, sf_dir, "events")
    counted = ev.groupBy("user_id").agg(F.when(F.col("user_id") % 2 == 0, F.count(F.lit(1)) + 3).otherwise(1).alias("counted"))
    out = ordered.order_cross_file(ev.join(counted, "user_id"), "user_id", list(EVENTS.order), 8, expected="counted")
    return out.select("event_id", "ord", "total", "omitted")


@says("""SELECT 'b' || conv_id // 50 AS id, conv_id * 1000 + turn AS entry, CASE WHEN (conv_id // 50) % 2 = 0 THEN '/p' ELSE '' END AS cwd, 'sessions' AS root FROM conversations
UNION ALL SELECT conv_id::VARCHAR, turn, NULL, 'projects' FROM conversations WHERE turn % 4 = 0 AND conv_id % 2 = 0""")
def session_roots(spark, sf_dir):
    """Two roots: one has session documents in `sessions`, fifty conversations to a document; the other `projects` as well,
    where lines of every second conversation lie within sixteen levels and the rest deeper."""
    c = _t(spark, sf_dir, "conversations")
    one, two = shared.new_path(spark, "root-documents"), shared.new_path(spark, "root-projects")
    # the lines of a file are its document: a head, then an entry to a line
    own = c.select(F.floor(F.col("conv_id") / 50).alias("b"), (F.col("conv_id") * 1000 + F.col("turn")).alias("n"))
    head = F.concat(F.lit('{"sessionId":"b'), F.col("b").cast("string"), F.lit('","cwd":"'), F.when(F.col("b") % 2 == 0, "/p").otherwise(""), F.lit('","entries":['))
    entry = F.concat(F.when(F.col("n") == F.col("first"), head).otherwise(","), F.to_json(F.struct(F.lit("user").alias("type"), F.col("n"))), F.when(F.col("n") == F.col("last"), "]}").otherwise(""))
    ends = own.groupBy("b").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    lines = own.join(ends, "b").select("b", "n", entry.alias("value")).repartition("b").sortWithinPartitions("b", "n")
    lines.select("b", "value").write.partitionBy("b").text(f"{one}/sessions")
    shared.rename(spark, f"{one}/sessions", ".txt", ".json")
    lines = conversation_lines(spark, sf_dir).withColumn("r", F.try_parse_json("raw")).where("r IS NOT NULL").withColumn("id", V.string_at(F.col("r"), "$.sessionId").cast("long")).where(F.try_variant_get("r", "$.turn", "int") % 4 == 0)
    deep = {0: "/".join(["d"] * 15), 1: "/".join(["d"] * 16)}
    for rest, below in deep.items():
        lines.where(F.col("id") % 2 == rest).select(F.col("raw").alias("value")).write.text(f"{two}/projects/{below}")
    c.limit(1).select(F.lit("{}").alias("value")).write.text(f"{two}/sessions")
    docs = logs.read_documents(spark, [logs.choose_root(spark, one)], "claude_code")
    entries = logs.document_records(docs).join(docs.select("file_path", "cwd"), "file_path")
    from_documents = entries.select("id", F.try_variant_get("record", "$.n", "bigint").alias("entry"), "cwd", F.regexp_extract("file_path", "/(sessions|projects)/", 1).alias("root"))
    read = logs.read_jsonl(spark, [logs.choose_root(spark, two)], "claude_code", glob="*.txt")
    from_lines = read.select(V.string_at(F.col("record"), "$.sessionId").alias("id"), F.try_variant_get("record", "$.turn", "bigint").alias("entry"), F.lit(None).cast("string").alias("cwd"), F.regexp_extract("file_path", "/(sessions|projects)/", 1).alias("root"))
    return from_documents.unionByName(from_lines)
