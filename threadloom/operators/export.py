"""Exports of one document per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.ordered import head_tail
from threadloom.schemas import Columns

#: Columns of a view that an export leaves out.
INTERNAL = ("_delete_ref", "_message_key", "_removed", "_origIdx")


def _parts(messages: DataFrame, m: Columns, keep: list[str], most: int, max_chars: int):
    """One array per session: at most `most` messages, each of at most `max_chars` characters, in order."""
    shown = head_tail(messages, m, most).withColumn(m.text, F.left(m.text, F.lit(max_chars)))
    items = F.sort_array(F.collect_list(F.struct("ord", F.struct(*keep).alias("v"))))
    return shown.groupBy(m.session).agg(F.transform(items, lambda x: x["v"]).alias("messages"), F.first("omitted").alias("omitted"))


def export_json(messages: DataFrame, m: Columns, *, summaries: DataFrame | None = None, events: DataFrame | None = None, most: int = 800, max_chars: int = 20_000, most_events: int = 1200) -> DataFrame:
    """session, json: its summary, its messages (internal columns left out), how many are omitted between head and tail, and
    its events with how many of them are omitted.

    `summaries` and `events` have m.session, events m.order too; a session that lacks either has null there, and without
    them it's left out. A session has at most `most` messages and `most_events` events, so what a row gathers is bounded.
    """
    own = lambda df: [c for c in df.columns if c not in (*INTERNAL, m.session)]
    out = _parts(messages, m, own(messages), most, max_chars)
    names = ["messages", "omitted"]
    if events is not None:
        shown = head_tail(events, m, most_events)
        items = F.sort_array(F.collect_list(F.struct("ord", F.struct(*own(events)).alias("v"))))
        gathered = shown.groupBy(m.session).agg(F.transform(items, lambda x: x["v"]).alias("raw_events"), F.first("omitted").alias("events_omitted"))
        out, names = out.join(gathered, m.session, "full"), [*names, "raw_events", "events_omitted"]
    if summaries is not None:
        about = summaries.select(m.session, F.struct(*own(summaries)).alias("summary"))
        out, names = about.join(out, m.session, "left"), ["summary", *names]
    return out.select(m.session, F.to_json(F.struct(F.col(m.session).alias("session"), *names)).alias("json"))


def export_markdown(messages: DataFrame, m: Columns, *, most: int = 800, max_chars: int = 20_000) -> DataFrame:
    """session, markdown: a heading for each role and its text, in order; a line tells of messages left out."""
    out = _parts(messages, m, [m.role, m.text], most, max_chars)
    each = F.transform("messages", lambda x: F.concat(F.lit("## "), F.coalesce(x[m.role], F.lit("unknown")), F.lit("\n\n"), F.coalesce(x[m.text], F.lit("")), F.lit("\n\n")))
    gap = F.when(F.col("omitted") > 0, F.concat(F.lit("_"), F.col("omitted").cast("string"), F.lit(" messages left out_\n\n")))
    head = (most + 1) // 2
    return out.select(m.session, F.concat(F.array_join(F.slice(each, 1, head), ""), F.coalesce(gap, F.lit("")), F.array_join(F.slice(each, head + 1, most), "")).alias("markdown"))


def export_session(summaries: DataFrame, messages: DataFrame, m: Columns, *, most: int = 800, max_chars: int = 20_000) -> DataFrame:
    """session, file_name, markdown of every summary: what it's about, then a heading and the shown text of each message;
    one in the middle stands for those left out. A session without messages has the first part alone.

    `summaries`: m.session, id, cwd, timestamp, model_provider, source, originator. A message is cut to max_chars, and a
    session has at most `most`: what one row gathers is bounded.
    """
    text = F.col(m.text)
    cut = F.coalesce(F.length(text) > max_chars, F.lit(False))
    shown = T.display_text(F.left(text, F.lit(max_chars)), cut, F.lit(None).cast("long"))
    each = head_tail(messages, m, most).select(m.session, "ord", F.coalesce(m.role, F.lit("unknown")).alias("role"), shown.alias("shown"), "omitted")
    last = each.where((F.col("ord") == (most + 1) // 2) & (F.col("omitted") > 0))
    gap = last.select(m.session, (F.col("ord") + 0.5).alias("ord"), F.lit("system").alias("role"), T.phrase("omitted", F.col("omitted")).alias("shown"))
    rows = each.select(m.session, F.col("ord").cast("double"), "role", "shown").unionByName(gap.withColumn("ord", F.col("ord").cast("double")))
    body = rows.groupBy(m.session).agg(F.sort_array(F.collect_list(F.struct("ord", "role", "shown"))).alias("_m"))
    part = F.transform("_m", lambda x: F.concat(F.lit("\n## "), x["role"], F.lit("\n\n"), x["shown"], F.lit("\n")))
    some = lambda c: T.blank_to_null(F.col(c))
    line = lambda name, value: F.concat(F.lit(f"- **{name}**: "), value, F.lit("\n"))
    head = F.concat(
        F.lit(f"# {T.PHRASES['session']}: "), F.coalesce(some("cwd"), "id"), F.lit("\n\n"), line(T.PHRASES["start_time"], T.display_time(F.col("timestamp"))),
        line("Provider", F.coalesce(some("model_provider"), F.lit("unknown"))), line(T.PHRASES["source"], F.coalesce(some("source"), some("originator"), F.lit("-"))), line(T.PHRASES["session_id"], F.col("id")),
    )
    name = F.concat(F.lit("session-"), T.clip_utf16(F.col("id"), 12), F.lit(".md"))
    out = summaries.select(m.session, "id", name.alias("file_name"), head.alias("_head")).join(body, m.session, "left")
    return out.select(m.session, "file_name", F.concat("_head", F.coalesce(F.array_join(part, ""), F.lit(""))).alias("markdown"))
