"""All queries of the library over the given tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import edit, export, normalize, ordered, query
from threadloom.schemas import Columns
from threadloom.streaming import refresh

CONV = Columns("conv_id", ("turn",), "role", "text", "", "")
EVENTS = Columns("user_id", ("ts", "event_id"), "event_type", "event_type", "ts", "event_type")
_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def says(sql: str):
    def keep(f):
        _found[f.__name__] = (f, sql)
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str = "ts"):
    return F.date_format(c, "yyyy-MM-dd")


@says("""WITH f AS (SELECT *, trim(text) <> '' AS ok FROM conversations)
SELECT conv_id, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_count, count(*) FILTER (role = 'assistant') AS assistant_count,
 count(*) FILTER (role = 'system') AS system_count, count(*) FILTER (role = 'tool') AS tool_count,
 md5(coalesce(arg_min(text, turn) FILTER (ok AND role = 'user'), '')) AS first_user_md5 FROM f GROUP BY conv_id""")
def session_summary(spark, sf_dir):
    out = ordered.summarize(_t(spark, sf_dir, "conversations"), CONV)
    return out.select("conv_id", "message_count", "user_count", "assistant_count", "system_count", "tool_count", F.md5(F.coalesce("first_user", F.lit(""))).alias("first_user_md5"))


@says("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL")
def role_histogram(spark, sf_dir):
    return ordered.role_histogram(_t(spark, sf_dir, "conversations"), CONV)


@says("SELECT user_id, min(event_id) AS lowest, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id")
def session_first_last(spark, sf_dir):
    out = ordered.first_and_last(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id")
    return out.select("user_id", "lowest", F.col("first").alias("first_event"), F.col("last").alias("last_event"))


@says("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def list_page(spark, sf_dir):
    df = query.filter_sessions(_t(spark, sf_dir, "orders"), provider="1-URGENT", names={"provider": "o_orderpriority"})
    return query.page(df, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@says("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def list_page_after(spark, sf_dir):
    return query.page(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", after=(200000.0, 0)).select("o_orderkey", "o_totalprice")


@says("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')")
def search_terms(spark, sf_dir):
    return query.search(_t(spark, sf_dir, "documents"), "the TION", text="text", with_snippet=False).select("doc_id")


@says("""SELECT doc_id, substr(lower(text), greatest(coalesce(nullif(instr(lower(text), 'the tion'), 0), nullif(instr(lower(text), 'the'), 0), 1) - 60, 1), 160) AS snippet
FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')""")
def search_snippet(spark, sf_dir):
    return query.search(_t(spark, sf_dir, "documents"), "the TION", text="text").select("doc_id", "snippet")


@says("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT event_id, user_id, ord, total, greatest(total - 11, 0) AS omitted FROM o WHERE ord <= 6 OR ord > total - 5""")
def head_tail(spark, sf_dir):
    return ordered.head_tail(_t(spark, sf_dir, "events"), EVENTS, 11).select("event_id", "user_id", "ord", "total", "omitted")


@says("""WITH l AS (SELECT *, CASE WHEN event_type IN ('click', 'view') AND coalesce(lag(event_type) OVER w IN ('click', 'view'), false) THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM l)
SELECT event_id, user_id, event_type FROM i QUALIFY event_type = first_value(event_type) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)""")
def mirror_dedupe(spark, sf_dir):
    """Role and text are the user here, so that neighbours of the pair mirror each other."""
    m = Columns("user_id", ("ts", "event_id"), "user_id", "user_id", "ts", "event_type")
    return ordered.drop_mirrored(_t(spark, sf_dir, "events"), m, ("click", "view")).select("event_id", "user_id", "event_type")


@says("""WITH k AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS)
 OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS resolved FROM k""")
def tool_name_asof(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    name = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    return ordered.resolve_tool_names(ev, "user_id", "k", ["ts", "event_id"], name).select("event_id", "resolved")


@says("SELECT DISTINCT name, value FROM (SELECT 'o_orderpriority' AS name, o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders) WHERE value <> ''")
def facets(spark, sf_dir):
    return query.facets(_t(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


@says("SELECT o_custkey, count(*) AS sessions, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(DISTINCT o_orderpriority) AS providers FROM orders GROUP BY o_custkey")
def projects(spark, sf_dir):
    return query.projects(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderpriority").withColumn("last", _day("last"))


@says("SELECT count(*) AS sessions, coalesce(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 0)::BIGINT AS events, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS active_days, printf('%.1f', count(*)::DOUBLE / count(DISTINCT strftime(ts, '%Y-%m-%d'))) AS per_day FROM events")
def stats_totals(spark, sf_dir):
    return query.stats_totals(_t(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long"), _day())


@says("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def count_by_day(spark, sf_dir):
    return query.count_by_day(_t(spark, sf_dir, "events"), _day())


@says("SELECT o_custkey AS label, count(*) AS count FROM orders GROUP BY 1 ORDER BY count DESC, label LIMIT 16")
def count_by_label(spark, sf_dir):
    return query.count_by(_t(spark, sf_dir, "orders"), "o_custkey", 16)


@says("SELECT label, count, count / sum(count) OVER () AS share FROM (SELECT source AS label, count(*) AS count FROM documents GROUP BY 1 ORDER BY count DESC, label LIMIT 6)")
def provider_share(spark, sf_dir):
    return query.share_of(query.count_by(_t(spark, sf_dir, "documents"), "source"))


@says("SELECT label, count, floor(100 * count / max(count) OVER () + 0.5)::BIGINT AS percent FROM (SELECT source AS label, count(*) AS count FROM documents GROUP BY 1)")
def percent_of_max(spark, sf_dir):
    return query.percent_of_max(query.count_by(_t(spark, sf_dir, "documents"), "source"))


@says("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def last_n_days(spark, sf_dir):
    return query.last_n_days(count_by_day(spark, sf_dir))


@says("""SELECT event_id, CASE WHEN strftime(ts, '%Y-%m-%d') = '2024-01-20' THEN 'today' WHEN strftime(ts, '%Y-%m-%d') = '2024-01-19' THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS day_label,
 count(*) OVER (PARTITION BY strftime(ts, '%Y-%m-%d')) AS group_size FROM events""")
def day_groups(spark, sf_dir):
    return ordered.day_groups(_t(spark, sf_dir, "events"), _day(), "2024-01-20").select("event_id", "day_label", "group_size")


@says("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS original_index FROM conversations QUALIFY role = 'user' AND contains(lower(text), 'the')")
def message_filter(spark, sf_dir):
    return query.filter_messages(_t(spark, sf_dir, "conversations"), CONV, query="The", role="user").select("conv_id", "turn", "original_index")


@says("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def overlay_hide(spark, sf_dir):
    return query.hide_marked(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"]).select("doc_id")


@says("SELECT md5(text) AS text_md5, arg_min(source, (source, doc_id)) AS source, arg_min(doc_id, (source, doc_id)) AS doc_id FROM documents GROUP BY md5(text)")
def first_root_wins(spark, sf_dir):
    df = _t(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "source", "doc_id")
    return query.first_root_wins(df, ["text_md5"], ["source", "doc_id"])


@says("""WITH p AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS a, max(event_id) AS b, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS v FROM events GROUP BY ALL)
SELECT user_id, count(*) AS files, arg_min(day, (a, day)) AS primary_file, min(a) AS first, max(b) AS last, sum(n)::BIGINT AS rows, sum(v)::BIGINT AS total FROM p GROUP BY user_id""")
def merge_partials(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("user_id", "event_id", _day().alias("day"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return ordered.merge_partials(ev, "user_id", "day", "event_id", "k")


@says("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN length(props) > 8 THEN length(props) END AS original_chars FROM events")
def event_payload(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(F.length("props") > 8, F.length("props")).cast("long").alias("original_chars"))


@says("SELECT doc_id, md5(left(text, 20000)) AS text_md5, length(text) > 20000 AS truncated, length(text) AS original_chars FROM documents")
def truncate_text(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    out = normalize.truncate_messages(docs.withColumn("_n", F.length("text").cast("long")), 20_000)
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.col("text_truncated").alias("truncated"), F.coalesce("original_text_chars", "_n").alias("original_chars"))


@says("""SELECT conv_id, turn, sha256('{"kind":"jsonl","session":"' || conv_id || '"}' || chr(0) || to_json(role) || chr(0) || to_json(text) || chr(0) || CASE WHEN turn % 2 = 0 THEN 'null' ELSE '"t' || turn || '"' END || chr(0) || '"message"' || chr(0) || '"text"') AS message_key FROM conversations""")
def message_key(spark, sf_dir):
    """Keys of turns as messages, every second one without a time."""
    c = _t(spark, sf_dir, "conversations").withColumns({"timestamp": F.when(F.col("turn") % 2 == 1, F.concat(F.lit("t"), F.col("turn").cast("string"))), "source_type": F.lit("message"), "source_subtype": F.lit("text")})
    identity = F.to_json(F.struct(F.lit("jsonl").alias("kind"), F.col("conv_id").cast("string").alias("session")))
    return c.select("conv_id", "turn", edit.message_key(identity).alias("message_key"))


@says("""SELECT provider, coalesce(a.n, 0) AS threads, coalesce(b.n, 0) AS jsonl FROM (SELECT c_mktsegment AS provider, count(*) AS n FROM customer GROUP BY 1) a
FULL JOIN (SELECT c_mktsegment AS provider, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) b USING (provider)""")
def census(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("provider"))
    return edit.provider_census(c, _t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")))


def _assigned(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("line_number"), F.col("o_orderpriority").alias("provider"))


@says("SELECT o_custkey::VARCHAR AS path, o_orderkey AS line_number, CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'none' ELSE o_orderpriority END AS provider FROM orders")
def relabel_apply(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    return edit.apply_relabel(a, edit.plan_relabel(a, ["5-LOW", "4-NOT SPECIFIED"], "none"))


@says("SELECT o_custkey::VARCHAR AS path, o_orderkey AS line_number, o_orderpriority AS provider, false AS conflict FROM orders")
def rollback(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    plan = edit.plan_relabel(a, ["5-LOW"], "none")
    return edit.rollback_relabel(edit.apply_relabel(a, plan), plan)


@says("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def redact_session(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return edit.redact_sessions(o, o.where("o_orderstatus = 'P'"), ["o_custkey"]).select("o_orderkey")


@says("""WITH k AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), hit AS (SELECT DISTINCT user_id, k FROM k WHERE event_type = 'signup' AND value > 50)
SELECT event_id FROM k WHERE NOT (event_type = 'signup' AND value > 50) AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.user_id = k.user_id AND hit.k = k.k)""")
def redact_cascade(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return edit.redact_cascade(ev, ev.where("event_type = 'signup' AND value > 50"), "user_id", "event_id", "k").select("event_id")


@says("SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' OR o_orderpriority = '5-LOW' AS fresh FROM orders WHERE o_orderstatus <> 'P'")
def incremental_refresh(spark, sf_dir):
    """The index holds all orders but those of status F, which count as changed; status P has vanished; an older parser
    read those of priority 5-LOW."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(2).alias("parser_version"))
    index = o.where("o_orderstatus <> 'F'").withColumn("fresh", F.lit(False))
    fresh, reusable = refresh.reuse_index(o.where("o_orderstatus <> 'P'"), index, ["o_orderkey", "o_totalprice", "o_orderstatus"], parser_version=2)
    return refresh.upsert_index(reusable, fresh.withColumn("fresh", F.lit(True))).select("o_orderkey", "o_totalprice", "fresh")


@says("SELECT conv_id, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS document FROM conversations GROUP BY conv_id HAVING sum(octet_length(encode(role)) + octet_length(encode(text)) + 2) <= 64000")
def search_document(spark, sf_dir):
    return ordered.search_document(_t(spark, sf_dir, "conversations"), CONV, 64_000)


def plain_sql(c: str) -> str:
    """Markdown's plain text in SQL."""
    for pattern, to in [
        (r"(?m)^\s*(```|~~~)[^\n]*$", " "), (r"!\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s*>\s?", ""),
        (r"(?m)^\s{0,3}(-(\s*-){2,}|\*(\s*\*){2,}|_(\s*_){2,})\s*$", " "), (r"(?m)^\s*([-+*]|\d+[.)])\s+", ""), (r"(?m)^\s*\|?(\s*:?-{3,}:?\s*\|)+\s*$", " "), (r"`+|\*\*|~~", ""), (r"<[^>]+>", " "), (r"\s+", " "),
    ]:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c})"


@says(f"WITH p AS (SELECT doc_id, {plain_sql('text')} AS plain FROM documents) SELECT doc_id, CASE WHEN length(plain) > 200 THEN left(plain, 197) || '...' ELSE plain END AS plain FROM p")
def markdown_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.compact(T.markdown_plain_text(F.col("text")), 200).alias("plain"))


@says("""WITH o AS (SELECT conv_id, '## ' || role || chr(10) || chr(10) || left(text, 20000) || chr(10) || chr(10) AS part, row_number() OVER w AS ord, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 k AS (SELECT conv_id, ord::DOUBLE AS ord, part FROM o WHERE ord <= 400 OR ord > total - 400 UNION ALL SELECT DISTINCT conv_id, 400.5, '_' || total - 800 || ' messages left out_' || chr(10) || chr(10) FROM o WHERE total > 800)
SELECT conv_id, string_agg(part, '' ORDER BY ord) AS markdown FROM k GROUP BY conv_id""")
def export_markdown(spark, sf_dir):
    """One Markdown text per conversation: a heading for each role and its text, in turn."""
    return export.export_markdown(_t(spark, sf_dir, "conversations"), CONV)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items()}
