"""Queries of the transcript operators: the given tables are rendered as records, artifacts and session documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import variants as V
from threadloom.operators import edit, export, normalize, ordered, query, summary
from threadloom.plans.registry import CONV, EVENTS, _t, plain_sql, says
from threadloom.sources import logs
from threadloom.streaming import refresh


def transcripts(spark, sf_dir) -> DataFrame:
    """conversations as transcript lines: a system turn is an event, a user's turn a text, an assistant's turn blocks: a
    thought, a tool call, the text. A tool's result comes as a user's block on every third turn."""
    c = _t(spark, sf_dir, "conversations")
    block = lambda kind, **f: F.to_json(F.struct(F.lit(kind).alias("type"), *(v.alias(k) for k, v in f.items())))
    text, call = F.col("text"), F.concat(F.lit("t"), F.col("turn").cast("string"))
    thought, use = block("thinking", thinking=text), block("tool_use", id=call, name=F.lit("run"), input=F.struct(F.col("turn").alias("n")))
    answered = F.concat(F.lit("t"), (F.col("turn") - 1).cast("string"))
    result = block("tool_result", tool_use_id=answered, content=text)
    content = F.when(F.col("role") == "assistant", F.concat(F.lit("["), thought, F.lit(","), use, F.lit(","), block("text", text=text), F.lit("]"))).when(F.col("turn") % 3 == 2, F.concat(F.lit("["), result, F.lit("]"))).otherwise(F.to_json(F.struct(text.alias("x"))))
    plain = (F.col("role") != "assistant") & (F.col("turn") % 3 != 2)
    said = F.when(plain, F.expr("substr(to_json(struct(text AS x)), 6, length(to_json(struct(text AS x))) - 6)")).otherwise(content)
    own = F.concat(F.lit('{"sessionId":"'), F.col("conv_id").cast("string"), F.lit('","type":"'), F.when(F.col("role") == "assistant", "assistant").otherwise("user"), F.lit('","timestamp":"2026-01-01T00:00:'), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit('Z","message":{"content":'), said, F.lit("}}"))
    event = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("/tmp/p").alias("cwd"), text.alias("content"), F.lit("developer").alias("role")).alias("payload")))
    raw = F.when(F.col("role") == "system", event).otherwise(own)
    return c.select(F.concat(F.lit("/logs/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file_path"), F.col("turn").alias("line_number"), raw.alias("raw")).withColumn("record", F.try_parse_json("raw")).withColumn("source_kind", F.lit("claude_code"))


_MESSAGES = """WITH m AS (SELECT conv_id, turn, 0 AS b, CASE role WHEN 'system' THEN 'developer' WHEN 'assistant' THEN 'assistant' ELSE CASE WHEN turn % 3 = 2 THEN 'tool' ELSE 'user' END END AS role, text,
  CASE role WHEN 'system' THEN 'session_meta' WHEN 'assistant' THEN 'thinking' ELSE CASE WHEN turn % 3 = 2 THEN 'tool_result' ELSE 'text' END END AS subtype, role IN ('system', 'assistant') AS context,
  CASE WHEN role = 'user' AND turn % 3 = 2 THEN CASE WHEN EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'assistant') THEN 'run' ELSE 't' || (turn - 1) END END AS tool FROM conversations c
 UNION ALL SELECT conv_id, turn, 1, 'tool', '[run] {"n":' || turn || '}', 'tool_use', false, 'run' FROM conversations WHERE role = 'assistant'
 UNION ALL SELECT conv_id, turn, 2, 'assistant', text, 'text', false, NULL FROM conversations WHERE role = 'assistant')
"""


@says(_MESSAGES + """SELECT conv_id::VARCHAR AS session, turn AS line_number, b AS message_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn, b) AS ord, role, md5(trim(text, ' ' || chr(10))) AS text_md5, subtype, context, tool FROM m""")
def normalize_messages(spark, sf_dir):
    out = normalize.normalize(transcripts(spark, sf_dir))
    session = F.regexp_extract("file_path", r"(\d+)", 1).alias("session")
    return out.select(session, "line_number", "message_index", "ord", "role", F.md5("text").alias("text_md5"), F.col("source_subtype").alias("subtype"), F.col("synthetic_context").alias("context"), F.col("tool_name").alias("tool"))


@says(_MESSAGES + """SELECT conv_id::VARCHAR AS id, 'claude_code:' || conv_id AS session_key, count(*) FILTER (b = 0) AS event_count, count(*) FILTER (NOT context) AS message_count, count(*) FILTER (context) AS context_count,
 count(*) FILTER (role = 'tool') AS tool_count, count(*) FILTER (role = 'user') AS user_count, 'anthropic' AS model_provider, CASE WHEN bool_or(role = 'developer') THEN '/tmp/p' ELSE '' END AS cwd,
 max('2026-01-01T00:00:' || lpad((turn % 60)::VARCHAR, 2, '0') || 'Z') FILTER (role <> 'developer') AS last_timestamp FROM m GROUP BY conv_id""")
def transcript_summary(spark, sf_dir):
    lines = transcripts(spark, sf_dir)
    out = summary.summarize_records(lines, normalize.normalize(lines))
    return out.select("id", "session_key", "event_count", "message_count", "context_count", "tool_count", F.coalesce(F.col("role_counts")["user"], F.lit(0)).alias("user_count"), "model_provider", "cwd", "last_timestamp")


@says("SELECT conv_id::VARCHAR AS session, turn AS line_number, CASE role WHEN 'system' THEN 'session_meta' ELSE role END AS type, role <> 'system' AS timed FROM conversations")
def event_projection(spark, sf_dir):
    out = normalize.events(transcripts(spark, sf_dir))
    return out.select(F.regexp_extract("file_path", r"(\d+)", 1).alias("session"), "line_number", "type", F.col("timestamp").isNotNull().alias("timed"))


@says("""WITH h AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS t, CASE WHEN event_type <> 'error' THEN event_type END AS display FROM events)
SELECT user_id::VARCHAR AS id, CASE WHEN user_id % 2 = 0 THEN '2020-01-01T00:00:00.000Z' ELSE arg_min(t, event_id) END AS timestamp, arg_max(t, event_id) AS last_timestamp, count(*) AS history_events, count(display) AS history_messages FROM h GROUP BY user_id""")
def history_enrichment(spark, sf_dir):
    """Every user is a session; their events are lines of the prompt history, those of type error without a display."""
    ev = _t(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("sessionId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("timestamp"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("display")))
    history = logs.history_rows(ev.select(F.lit("history.jsonl").alias("file_path"), F.col("event_id").alias("line_number"), line.alias("raw")).withColumn("record", F.try_parse_json("raw")))
    legacy = ev.select("user_id").distinct().select(F.col("user_id").cast("string").alias("id"), F.when(F.col("user_id") % 2 == 0, "2020-01-01T00:00:00.000Z").alias("timestamp"))
    return summary.enrich_history(legacy, history).select("id", "timestamp", "last_timestamp", "history_events", "history_messages")


def artifact_files(spark, sf_dir) -> DataFrame:
    """conversations as artifact files: of each four turns a prompt, its answer and two fragments, the second of which
    leaves a gap in odd conversations."""
    c = _t(spark, sf_dir, "conversations")
    name = F.concat(F.lit("a"), F.floor(F.col("turn") / 4).cast("string"))
    ending = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, ".resolved").when(F.col("turn") % 4 == 2, ".resolved.0").when(F.col("conv_id") % 2 == 1, ".resolved.2").otherwise(".resolved.1")
    files = c.select(F.col("conv_id").cast("string").alias("session"), F.concat(name, ending).alias("name"), F.col("text").alias("content"))
    side = c.where("turn % 4 = 0 AND conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("session"), F.concat(name, F.lit(".metadata.json")).alias("name"), F.concat(F.lit('{"updatedAt":'), (F.lit(1767225600000) + F.col("turn")).cast("string"), F.lit("}")).alias("content"))
    return files.unionByName(side)


@says("""SELECT conv_id::VARCHAR AS session, 'a' || turn // 4 AS name, turn % 4 - 1 AS part, CASE WHEN turn % 4 = 0 THEN 'user' ELSE 'assistant' END AS role, md5(text) AS text_md5,
 CASE WHEN turn % 4 = 0 AND conv_id % 3 = 0 THEN '2026-01-01T00:00:00.' || lpad(turn::VARCHAR, 3, '0') || 'Z' ELSE '' END AS timestamp FROM conversations WHERE turn % 4 < 3 OR conv_id % 2 = 0""")
def artifact_messages(spark, sf_dir):
    return logs.artifact_messages(artifact_files(spark, sf_dir)).select("session", "name", "part", "role", F.md5("text").alias("text_md5"), "timestamp")


@says("SELECT session, count(*) || ':' || sum(('0x' || substr(md5(text), 1, 12))::BIGINT)::VARCHAR AS fingerprint FROM (SELECT conv_id::VARCHAR AS session, text FROM conversations WHERE turn % 4 = 0) GROUP BY session")
def artifact_fingerprint(spark, sf_dir):
    return refresh.artifact_hint_fingerprint(logs.artifact_messages(artifact_files(spark, sf_dir)))


@says("""SELECT a.conv_id, a.turn FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE turn || ': ' || text END AS text FROM conversations) a
WHERE NOT EXISTS (SELECT 1 FROM conversations m WHERE m.conv_id = a.conv_id AND CASE WHEN length(left(a.text, 80)) < 16 THEN a.text = m.text ELSE contains(m.text, left(a.text, 80)) END)""")
def prefix_dedupe(spark, sf_dir):
    """Every turn is an artifact too, every second one with another beginning."""
    c = _t(spark, sf_dir, "conversations")
    other = F.concat(F.col("turn").cast("string"), F.lit(": "), F.col("text"))
    asks = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(other).alias("text"))
    return edit.drop_duplicate_prompts(asks, c, session="conv_id").select("conv_id", "turn")


@says("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE turn <> conv_id % 5 + 1) WHERE n = turn")
def contiguous_run(spark, sf_dir):
    return ordered.contiguous_prefix(_t(spark, sf_dir, "conversations").where("turn <> conv_id % 5 + 1"), "conv_id", "turn").select("conv_id", "turn")


@says("""WITH o AS (SELECT event_id, user_id, row_number() OVER w AS ord, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY CAST(json_extract(props, '$.k') AS BIGINT), strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id))
SELECT event_id, ord, greatest(total - 20, 0) AS omitted FROM o WHERE ord <= 10 OR ord > total - 10""")
def cross_file_order(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ordered.order_cross_file(ev, "user_id", ["k", "t", "event_id"], 20).select("event_id", "ord", "omitted")


def _orders_as_sessions(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.concat(F.lit("codex:"), F.col("o_orderkey").cast("string")).alias("session_key"), F.col("o_custkey").cast("string").alias("id"), F.lit("codex").alias("source_kind"), F.when(F.col("o_orderkey") % 3 == 0, F.pmod(F.col("o_orderkey"), F.lit(500)).cast("string")).alias("parent_session_id"))


@says("""SELECT c_custkey::VARCHAR AS key, min('codex:' || o_orderkey) AS session_key FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) = 1
UNION ALL SELECT 'codex:' || c_custkey, 'codex:' || c_custkey FROM customer WHERE c_custkey IN (SELECT o_orderkey FROM orders)""")
def resolve_keys(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    keys = _t(spark, sf_dir, "customer").select(F.explode(F.array(k, F.concat(F.lit("codex:"), k))).alias("key"))
    return summary.resolve_keys(_orders_as_sessions(spark, sf_dir), keys)


@says("""WITH p AS (SELECT o_custkey, min('codex:' || o_orderkey) AS k FROM orders GROUP BY 1)
SELECT 'codex:' || o_orderkey AS session_key, p.k AS parent_key FROM orders LEFT JOIN p ON p.o_custkey = orders.o_orderkey % 500 WHERE o_orderkey % 3 = 0""")
def link_parents(spark, sf_dir):
    return summary.link_parents(_orders_as_sessions(spark, sf_dir))


@says("SELECT o_orderpriority AS source_kind, arg_min(o_orderstatus, o_orderkey) AS display_source, min(o_orderkey) AS root_rank FROM orders GROUP BY 1")
def sources(spark, sf_dir):
    return summary.sources(_t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source_kind"), F.col("o_orderstatus").alias("display_source"), F.col("o_orderkey").alias("root_rank")))


@says("""SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]+)$', 1) AS name, regexp_matches(url, '^(https?:|mailto:|#)', 'i') AS safe, regexp_full_match(url, '[A-Za-z0-9_.:-]{1,128}') AS provider_like,
 NOT regexp_matches(url, '[/:]') AS one_component FROM pages""")
def link_fields(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", T.basename(u).alias("name"), T.safe_link(u).alias("safe"), T.valid_provider(u).alias("provider_like"), T.valid_session_id(u).alias("one_component"))


def _relabel(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    return o.select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("line_number"), F.substring("o_orderpriority", 3, 20).alias("provider")), c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("provider"))


_RELABEL = """WITH a AS (SELECT o_custkey AS path, o_orderkey AS line_number, substr(o_orderpriority, 3, 20) AS provider FROM orders), t AS (SELECT c_custkey AS id, c_mktsegment AS provider FROM customer),
 c AS (SELECT coalesce(x.provider, y.provider) AS provider, coalesce(x.n, 0) AS threads, coalesce(y.n, 0) AS jsonl FROM (SELECT provider, count(*) AS n FROM t GROUP BY 1) x FULL JOIN (SELECT provider, count(*) AS n FROM a GROUP BY 1) y ON x.provider = y.provider),
 p AS (SELECT *, regexp_full_match(provider, '[A-Za-z0-9_.:-]{1,128}') AS valid, provider IN ('LOW', 'HIGH') AS selected FROM c)
"""


def _tree(table: str, row: str) -> str:
    """A tree of digests of a table's rows, as SQL."""
    node = "sha256(string_agg(h, '' ORDER BY h))"
    leaves = f"SELECT d, sha256(d || ':' || count(*)) AS h FROM (SELECT sha256({row}) AS d FROM {table}) GROUP BY d"
    for digits in (6, 3):
        leaves = f"SELECT left(d, {digits}) AS d, {node} AS h FROM ({leaves}) GROUP BY 1"
    return f"(SELECT {node} FROM ({leaves}))"


@says(_RELABEL + "SELECT provider, threads, jsonl, valid, valid AND provider <> 'URGENT' AS candidate, selected FROM p")
def relabel_providers(spark, sf_dir):
    return edit.relabel_providers(*_relabel(spark, sf_dir), edit.select_providers("LOW, HIGH", "URGENT"), "URGENT")


@says(_RELABEL + """, f AS (SELECT path, count(*) FILTER (provider IN ('LOW', 'HIGH')) AS n FROM a GROUP BY path)
SELECT (SELECT count(*) FROM p WHERE valid AND provider <> 'URGENT') AS candidates, count(*) AS files_scanned, count(*) FILTER (n > 0) AS files_to_change, sum(n)::BIGINT AS replacements,
 (SELECT count(*) FROM t WHERE provider IN ('LOW', 'HIGH')) AS thread_matches, (SELECT '[' || string_agg('{"source":"' || provider || '","target":"URGENT","threads":' || threads || ',"jsonl":' || jsonl || '}', ',' ORDER BY provider) || ']' FROM p WHERE selected) AS mappings,
 'current_provider_only' AS warnings, CASE WHEN (SELECT bool_and(valid) FROM p) THEN '' ELSE 'invalid_provider_id' END AS blockers, (SELECT bool_and(valid) FROM p) AS can_apply, sum(n) > 0 AS has_changes, false AS selection_required,
 sha256(""" + _tree("a", """'{"path":"' || path || '","line_number":' || line_number || ',"provider":"' || provider || '"}'""") + " || ':' || " + _tree("t", """'{"id":' || id || ',"provider":"' || provider || '"}'""") + """ || ':' || '[["HIGH", "LOW"], "URGENT"]') AS plan_id FROM f""")
def relabel_preview(spark, sf_dir):
    return edit.preview_relabel(*_relabel(spark, sf_dir), edit.select_providers("LOW, HIGH", "URGENT"), "URGENT")


@says("SELECT o_custkey AS path, o_orderkey AS line_number, CASE WHEN o_orderpriority = '5-LOW' THEN 'new' ELSE o_orderpriority END AS provider, o_orderstatus AS status FROM orders")
def relabel_records(spark, sf_dir):
    """Orders as session_meta lines; planned lines get a new provider, their other fields stay."""
    o = _t(spark, sf_dir, "orders")
    raw = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("o_orderpriority").alias("model_provider"), F.col("o_orderstatus").alias("status")).alias("payload")))
    records = o.select(F.col("o_custkey").alias("file_path"), F.col("o_orderkey").alias("line_number"), raw.alias("raw")).withColumn("record", F.parse_json("raw"))
    plan = edit.plan_relabel(logs.scan_assignments(records), ["5-LOW"], "new")
    r = F.col("record")
    return edit.relabel_records(records, plan).select(F.col("file_path").alias("path"), "line_number", V.string_at(r, "$.payload.model_provider").alias("provider"), V.string_at(r, "$.payload.status").alias("status"))


@says("SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'other' ELSE c_mktsegment END AS provider FROM customer")
def relabel_threads(spark, sf_dir):
    threads = logs.read_threads(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("model_provider")))
    return edit.relabel_threads(threads, ["BUILDING", "MACHINERY"], "other")


@says("SELECT provider, count(*) AS n FROM (SELECT substr(o_orderpriority, 3, 20) AS provider FROM orders UNION ALL SELECT c_mktsegment FROM customer) WHERE provider IN ('LOW', 'BUILDING') GROUP BY 1")
def relabel_left(spark, sf_dir):
    return edit.verify_relabel(*_relabel(spark, sf_dir), ["LOW", "BUILDING"])


@says("SELECT conv_id, count(*) AS entries, sum(('0x' || substr(md5(turn || ':' || text), 1, 12))::BIGINT)::VARCHAR AS text_hash FROM conversations WHERE turn % 3 <> 1 GROUP BY conv_id")
def redact_entries(spark, sf_dir):
    """Turns as entries of session documents; those of every third turn go, by place and fingerprint."""
    c = _t(spark, sf_dir, "conversations")
    entries = c.select(F.col("conv_id").alias("file_path"), F.col("turn").alias("entry_index"), F.parse_json(F.to_json(F.struct("turn", "text"))).alias("entry"))
    mark = F.when(F.col("entry_index") % 3 == 1, edit.entry_fingerprint(F.col("entry"))).otherwise("stale")
    kept, _ = edit.redact_entry_rows(entries, entries.select("file_path", "entry_index", mark.alias("fingerprint")))
    own = kept.select(F.col("file_path").alias("conv_id"), F.concat(F.col("entry_index").cast("string"), F.lit(":"), V.string_at(F.col("entry"), "$.text")).alias("t"))
    return own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(edit.row_hash("t")).cast("string").alias("text_hash"))


@says("""WITH o AS (SELECT *, row_number() OVER w AS ord, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 m AS (SELECT conv_id, count(*) FILTER (ord <= 400 OR ord > total - 400) AS messages, md5(string_agg(role || ':' || left(text, 20000), '|' ORDER BY turn) FILTER (ord <= 400 OR ord > total - 400)) AS text_md5,
  max(total) AS message_count, string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (role = 'system' ) AS events FROM o GROUP BY conv_id)
SELECT conv_id, messages, text_md5, message_count, coalesce(events, '') AS events FROM m""")
def export_json(spark, sf_dir):
    """Every conversation as one JSON document, read back: its messages, its summary, and its system turns as events."""
    c = _t(spark, sf_dir, "conversations")
    about = ordered.summarize(c, CONV).select("conv_id", "message_count", "title")
    out = export.export_json(c, CONV, summaries=about, events=c.where("role = 'system'").select("conv_id", "turn", F.lit("system").alias("type")))
    d = F.from_json("json", "session long, messages array<struct<role string, text string>>, summary struct<message_count long>, raw_events array<struct<turn string>>")
    text = F.array_join(F.transform(d["messages"], lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|")
    events = F.array_join(F.transform(F.coalesce(d["raw_events"], F.array().cast("array<struct<turn string>>")), lambda x: x["turn"]), ",")
    return out.select("conv_id", F.size(d["messages"]).cast("long").alias("messages"), F.md5(text).alias("text_md5"), d["summary"]["message_count"].alias("message_count"), events.alias("events"))


@says("""SELECT '/c' || o_custkey || '/' || o_orderkey AS file_path, 'k' || o_orderkey AS session_key, o_orderkey % 7 = 3 AS fresh FROM orders WHERE o_custkey % 10 <> 0 OR o_orderkey % 7 = 3""")
def refresh_paths(spark, sf_dir):
    """Directories of every tenth customer are gone; every seventh order is a changed file."""
    o = _t(spark, sf_dir, "orders")
    folder = F.concat(F.lit("/c"), F.col("o_custkey").cast("string"))
    store = o.select(F.concat(folder, F.lit("/"), F.col("o_orderkey").cast("string")).alias("file_path"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("session_key"), F.lit(False).alias("fresh"))
    new = store.where(F.substring("session_key", 2, 20).cast("long") % 7 == 3).withColumn("fresh", F.lit(True))
    changed = new.select(F.col("file_path").alias("path"), F.lit(False).alias("gone")).unionByName(o.where("o_custkey % 10 = 0").select(folder.alias("path"), F.lit(True).alias("gone")).distinct())
    return refresh.refresh_paths(store, changed, new)


@says("SELECT conv_id, turn, md5(left(text, 50)) AS text_md5, length(text) > 50 AS text_truncated, CASE WHEN length(text) > 50 THEN length(text) END AS original_text_chars FROM conversations")
def truncate_messages(spark, sf_dir):
    return normalize.truncate_messages(_t(spark, sf_dir, "conversations"), 50).select("conv_id", "turn", F.md5("text").alias("text_md5"), "text_truncated", "original_text_chars")


@says("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS original_index FROM events QUALIFY event_type = 'click'")
def event_filter(spark, sf_dir):
    return query.filter_messages(_t(spark, sf_dir, "events"), EVENTS, role="click", show_tools=True).select("event_id", "original_index")


@says(f"SELECT doc_id, coalesce(length({plain_sql('text')}) > 1800, false) AS folded FROM documents")
def folded_messages(spark, sf_dir):
    shown = T.display_text(F.col("text"), F.lit(False), F.lit(None).cast("long"))
    return _t(spark, sf_dir, "documents").select("doc_id", T.starts_collapsed(F.lit("user"), F.lit(False), shown).alias("folded"))


@says("""WITH s AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN length(q) > 60 THEN rtrim(left(q, 57)) || '...' ELSE q END) AS short_md5,
 md5(CASE WHEN turn % 5 = 4 THEN turn || ' messages in the middle were omitted for safe display' WHEN length(text) > 50 THEN left(text, 50) || chr(10) || chr(10) || 'This message is too large; only the first 50 characters are shown' ELSE text END) AS shown_md5,
 CASE WHEN turn % 2 = 0 AND conv_id % 2 = 0 THEN 'codex_archived' ELSE 'codex' END AS kind FROM s""")
def shown_text(spark, sf_dir):
    """Every fifth turn stands for omitted messages; archived are even turns, of which even conversations have an archive."""
    text, turn = F.col("text"), F.col("turn")
    shown = T.display_text(F.left(text, F.lit(50)), F.length(text) > 50, F.when(turn % 5 == 4, turn))
    kind = T.shown_kind(F.lit("codex"), turn % 2 == 0, F.when(F.col("conv_id") % 2 == 0, "codex").otherwise(""))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.compact_text(text, 60)).alias("short_md5"), F.md5(shown).alias("shown_md5"), kind.alias("kind"))


@says("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders), p AS (SELECT o_orderkey, i - (SELECT coalesce(max(i), 0) FROM o WHERE o_orderkey = 7) AS i FROM o)
SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY i) FILTER (i <= 50) AS keys, count(*) > 50 AS has_more, CASE WHEN count(*) > 50 THEN max(o_orderkey::VARCHAR) FILTER (i = 50) END AS next_cursor FROM p WHERE i > 0""")
def page_object(spark, sf_dir):
    return query.page_object(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", cursor="7").withColumn("keys", F.array_join("keys", ","))


@says("""SELECT '/c/' || o_custkey AS path, o_custkey::VARCHAR AS name, count(*) AS count, max(o_orderdate::DATE::VARCHAR) AS last_timestamp, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS providers,
 string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS source_kinds FROM orders GROUP BY o_custkey""")
def project_list(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("cwd"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.col("o_orderpriority").alias("model_provider"), F.col("o_orderstatus").alias("source_kind"))
    return query.project_list(o).withColumns({c: F.array_join(c, ",") for c in ("providers", "source_kinds")})


@says("""WITH o AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, count(*) OVER (PARTITION BY conv_id) AS total,
  CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || chr(10) || 'This message is too large; only the first 100 characters are shown' ELSE text END AS shown FROM conversations),
 k AS (SELECT conv_id, ord::DOUBLE AS ord, role, shown FROM o WHERE ord <= 3 OR ord > total - 3 UNION ALL SELECT DISTINCT conv_id, 3.5, 'system', total - 6 || ' messages in the middle were omitted for safe display' FROM o WHERE total > 6)
SELECT conv_id, 'session-' || conv_id || '.md' AS file_name, md5('# Session: ' || CASE WHEN conv_id % 2 = 0 THEN '/tmp/p' ELSE conv_id::VARCHAR END || chr(10) || chr(10) || '- **Start Time**: ' || CASE WHEN conv_id % 3 = 0 THEN 'Unknown time' ELSE 'Jan 2, 2026, 3:04:05 PM' END
 || chr(10) || '- **Provider**: unknown' || chr(10) || '- **Source**: cli' || chr(10) || '- **Session ID**: ' || conv_id || chr(10) || string_agg(chr(10) || '## ' || role || chr(10) || chr(10) || shown || chr(10), '' ORDER BY ord)) AS markdown_md5 FROM k GROUP BY conv_id""")
def export_session(spark, sf_dir):
    """Every conversation as Markdown with its heading, six messages of 100 characters at most."""
    c = _t(spark, sf_dir, "conversations")
    even = F.when(F.col("conv_id") % 2 == 0, "/tmp/p").otherwise("")
    local = F.date_format(F.to_utc_timestamp(F.lit("2026-01-02 15:04:05"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    about = c.select("conv_id").distinct().select(
        "conv_id", F.col("conv_id").cast("string").alias("id"), even.alias("cwd"), F.when(F.col("conv_id") % 3 == 0, "").otherwise(local).alias("timestamp"),
        F.lit("").alias("model_provider"), F.lit("cli").alias("source"), F.lit("").alias("originator"),
    )
    return export.export_session(about, c, CONV, most=6, max_chars=100).select("conv_id", "file_name", F.md5("markdown").alias("markdown_md5"))


def _documents_and_history(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every user is a session document of one of three roots, even ones with a prompt, odd ones with entries; events are
    lines of the history, those of type error no JSON."""
    ev = _t(spark, sf_dir, "events")
    root, own = F.concat(F.lit("/r"), (F.col("user_id") % 3).cast("string")), F.col("user_id").cast("string")
    record = F.when(F.col("user_id") % 2 == 0, F.lit('{"prompt": "go"}')).otherwise('{"prompt": "no", "entries": []}')
    docs = ev.select("user_id").distinct().select(F.concat(root, F.lit("/sessions/"), own, F.lit(".json")).alias("file_path"), own.alias("id"), F.lit("").alias("timestamp"), F.parse_json(record).alias("record"))
    line = F.when(F.col("event_type") == "error", "{bad").otherwise(F.to_json(F.struct(own.alias("sessionId"), F.col("event_type").alias("display"))))
    lines = ev.select(F.concat(root, F.lit("/history.jsonl")).alias("file_path"), F.col("event_id").alias("line_number"), line.alias("raw"))
    return docs, logs.history_rows(lines.withColumn("record", F.try_parse_json("raw")))


@says("""WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT '/r' || user_id % 3 || '/sessions/' || user_id || '.json' AS file_path, user_id::VARCHAR AS id, NULL::BIGINT AS line_number, 'info' AS type FROM u
UNION ALL SELECT '/r' || user_id % 3 || '/sessions/' || user_id || '.json', user_id::VARCHAR, 1, 'user' FROM u WHERE user_id % 2 = 0
UNION ALL SELECT '/r' || user_id % 3 || '/sessions/' || user_id || '.json', user_id::VARCHAR, event_id, 'user_input' FROM events WHERE event_type <> 'error'
UNION ALL SELECT '/r' || user_id % 3 || '/history.jsonl', NULL, event_id, 'parse_error' FROM events WHERE event_type = 'error'""")
def document_events(spark, sf_dir):
    return logs.document_events(*_documents_and_history(spark, sf_dir)).select("file_path", "id", "line_number", "type")


@says("""WITH b AS (SELECT user_id % 3 AS r, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1)
SELECT user_id::VARCHAR AS id, 2 - user_id % 2 + count(*) FILTER (event_type <> 'error') + any_value(b.n) AS event_count FROM events JOIN b ON b.r = user_id % 3 GROUP BY user_id""")
def document_event_counts(spark, sf_dir):
    return logs.document_event_counts(*_documents_and_history(spark, sf_dir)).select("id", "event_count")


@says("SELECT user_id::VARCHAR AS id, event_id AS line_number, 'user' AS role, event_type AS text FROM events WHERE event_type <> 'error'")
def history_messages(spark, sf_dir):
    return logs.history_messages(*_documents_and_history(spark, sf_dir)).select("id", "line_number", "role", "text")


@says("""SELECT conv_id // 3 AS file_path, count(*) AS n_left, sum(('0x' || substr(md5(text), 1, 12))::BIGINT)::VARCHAR AS text_hash FROM conversations WHERE conv_id % 4 <> 1 OR turn % 5 = 4 GROUP BY 1""")
def redact_array_logs(spark, sf_dir):
    """Three conversations to an array log; every fourth conversation goes, but for turns that name no session."""
    c = _t(spark, sf_dir, "conversations")
    own = F.when(F.col("turn") % 5 != 4, F.col("conv_id").cast("string")).alias("sessionId")
    elements = c.select(F.floor(F.col("conv_id") / 3).alias("file_path"), F.col("turn").alias("line_number"), F.parse_json(F.to_json(F.struct(own, "text"))).alias("record"))
    left = edit.redact_element_rows(elements, c.where("conv_id % 4 = 1").select(F.col("conv_id").cast("string").alias("id")))
    text = left.select("file_path", V.string_at(F.col("record"), "$.text").alias("t"))
    return text.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_left"), F.sum(edit.row_hash("t")).cast("string").alias("text_hash"))


@says("""SELECT conv_id::VARCHAR AS session, turn AS line_number FROM conversations c WHERE NOT (role = 'assistant' AND turn % 3 = 1)
 AND NOT (role NOT IN ('assistant', 'system') AND turn % 3 = 2 AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'assistant'))""")
def redact_lines(spark, sf_dir):
    """Tool calls of every third turn go, each with the line of its result; references to other turns are stale."""
    lines = transcripts(spark, sf_dir)
    call = lines.where(V.string_at(F.col("record"), "$.type") == "assistant")
    mark = F.when(F.col("line_number") % 3 == 1, edit.entry_fingerprint(F.col("record"))).otherwise("stale")
    kept, _ = edit.redact_records(lines, call.select("file_path", "line_number", F.lit(1).alias("message_index"), mark.alias("fingerprint")))
    return kept.select(F.regexp_extract("file_path", r"(\d+)", 1).alias("session"), "line_number")


@says("""WITH e AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, strftime(ts, '%Y-%m-%d') AS day FROM events),
 p AS (SELECT user_id, day, min(t) AS a, max(t) AS b, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, CASE WHEN max(event_id) % 2 = 0 THEN '/d' || day ELSE '' END AS cwd FROM e GROUP BY user_id, day)
SELECT user_id::VARCHAR AS id, arg_min(day, a) AS file_path, min(a) AS timestamp, max(b) AS last_timestamp, coalesce(arg_max(cwd, day) FILTER (cwd <> ''), '') AS cwd, sum(n)::BIGINT AS event_count, sum(clicks)::BIGINT AS clicks, count(*) AS files FROM p GROUP BY user_id""")
def merge_summaries(spark, sf_dir):
    """A user's events of a day are a file of a session."""
    ev = _t(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    no = F.lit("")
    parts = ev.groupBy(F.col("user_id").cast("string").alias("id"), F.col("day").alias("file_path")).agg(
        F.min("t").alias("timestamp"), F.max("t").alias("last_timestamp"), F.when(F.max("event_id") % 2 == 0, F.concat(F.lit("/d"), F.first("day"))).otherwise("").alias("cwd"),
        F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("event_type") == "click").alias("clicks"),
    )
    parts = parts.withColumns({"model_provider": no, "originator": no, "message_count": F.col("event_count"), "context_count": F.lit(0), "role_counts": F.create_map(F.lit("click"), F.col("clicks")), "first_user": no, "first_assistant": no, "first_message": no})
    out = summary.merge_summaries(parts)
    return out.select("id", "file_path", "timestamp", "last_timestamp", "cwd", "event_count", F.col("role_counts")["click"].alias("clicks"), "files")


@says("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def prune_missing(spark, sf_dir):
    """Orders are index rows; files are customers with money left."""
    there = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return refresh.prune_missing(_t(spark, sf_dir, "orders"), there, "o_custkey").select("o_orderkey")


@says("SELECT conv_id, turn, turn % 4 = 0 AS stale FROM conversations")
def stale_references(spark, sf_dir):
    """References to all turns; of every fourth turn the text was another."""
    c = _t(spark, sf_dir, "conversations")
    refs = c.select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text")).select("conv_id", "turn", edit.fingerprint("text").alias("fingerprint"))
    good, stale = edit.check_references(c, refs, ["conv_id", "turn"], edit.fingerprint("text"))
    return good.withColumn("stale", F.lit(False)).unionByName(stale.withColumn("stale", F.lit(True)))


@says("SELECT conv_id::VARCHAR AS session, 'a' || turn // 4 AS name FROM conversations WHERE turn % 4 = 0 AND NOT (conv_id % 2 = 0 AND turn % 8 = 0)")
def redact_artifacts(spark, sf_dir):
    """Prompts of even conversations go where the reference still holds: every second one."""
    files = artifact_files(spark, sf_dir).where(~F.contains("name", F.lit(".")))
    even, place = F.col("session").cast("long") % 2 == 0, F.substring("name", 2, 9).cast("long")
    seen = F.when(place % 2 == 0, F.col("content")).otherwise(F.concat("content", F.lit("!")))
    refs = files.where(even).select("session", "name", F.sha2(seen.cast("binary"), 256).alias("fingerprint"))
    return edit.redact_artifacts(files, refs).select("session", "name")


@says("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || left(strftime(ts, '%f'), 3) || 'Z' AS stamp, left(user_id || ' is not a time', 10) AS other_day,
 (SELECT left(foreign_text, k) FROM range(1, 11) r(k) WHERE strlen(left(foreign_text, k)) = 10 ORDER BY k LIMIT 1) AS foreign_day
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'é' || user_id || 'ééééééé' WHEN 1 THEN event_id || '日本語日本語' ELSE 'é' || user_id END AS foreign_text FROM events)""")
def time_fields(spark, sf_dir):
    """Event times as epoch milliseconds, as RFC 3339 text, and text that is no time, in ASCII and in characters of more bytes."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    millis = F.unix_millis(F.from_utc_timestamp("ts", F.current_timezone()))
    user, other = F.col("user_id").cast("string"), F.pmod("event_id", F.lit(3))
    foreign = F.when(other == 0, F.concat(F.lit("é"), user, F.lit("é" * 7))).when(other == 1, F.concat(F.col("event_id").cast("string"), F.lit("日本語日本語"))).otherwise(F.concat(F.lit("é"), user))
    return _t(spark, sf_dir, "events").select(
        "event_id", T.local_day(text).alias("day"), T.epoch_or_text(millis.cast("string")).alias("stamp"), T.local_day(F.concat(user, F.lit(" is not a time"))).alias("other_day"), T.local_day(foreign).alias("foreign_day"),
    )
