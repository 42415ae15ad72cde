"""One row per transcript file from its records and messages, and what joins to it: history, keys, parents, roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import variants as V
from threadloom.operators import ordered, query

#: Fields that give a working directory while a transcript has none, in order.
OTHER_CWD = ("workingDirectory", "working_directory", "workspace", "workspaceDir", "projectRoot", "project_root")

#: Provider and originator of a format whose records name none.
DEFAULTS = {"claude_code": ("anthropic", "claude_code"), "gemini": ("google", "google_gemini")}

#: Fields of a summary that its search document begins with.
SEARCH_FIELDS = ("id", "session_key", "title", "preview_text", "cwd", "file_path", "source_kind", "display_source", "model_provider", "source", "originator")

TITLE_CHARS, PREVIEW_CHARS = 90, 160
RUN_LINES = 4096


def _last(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


def _first(value: Column, order: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), order))


def record_facts(records: DataFrame, given: tuple[str, ...] = ()) -> DataFrame:
    """Per file: first and last time, id, cwd, provider, originator, hidden and why, parent, event_count, and the columns
    `given`, which are the same on all rows of a file.

    Later records win, but for the first time. A cwd under another name counts only while there is none. Empty strings
    are values here, except as times; records that are no JSON don't count. Records are read once; of a run of RUN_LINES
    lines only the directories under other names are gathered, of a file one for each run.
    """
    r, line = F.col("record"), F.col("line_number")
    named = ("timestamp", "sessionId", "cwd", "modelProvider", "model_provider", "provider", "message.provider", "agentId", "agent_id", "type", *OTHER_CWD)
    paths = [*(f"$.{n}" for n in named), *(f"$.payload.{n}" for n in ("id", "cwd", "model_provider", "originator"))]
    flags = records.where(r.isNotNull()).select("file_path", line, *given, V.strings_at(r, *paths).alias("s"), V.at(r, "$.payload.source.subagent").isNotNull().alias("sub"), V.true_at(r, "$.isSidechain").alias("sidechain"))
    s = {n: F.col("s")[i] for i, n in enumerate((*named, "meta_id", "meta_cwd", "meta_provider", "meta_originator"))}
    meta = s["type"] == "session_meta"
    in_meta = lambda n: F.when(meta, s[f"meta_{n}"])
    slim = flags.select(
        "file_path", line, *given, T.blank_to_null(s["timestamp"]).alias("ts"), in_meta("id").alias("meta_id"), s["sessionId"].alias("own_id"),
        F.coalesce(s["cwd"], in_meta("cwd")).alias("direct"), F.coalesce(*(T.blank_to_null(s[k]) for k in OTHER_CWD)).alias("other"),
        F.coalesce(*(s[n] for n in ("modelProvider", "model_provider", "provider", "message.provider")), in_meta("provider")).alias("provider"),
        in_meta("originator").alias("originator"), F.coalesce(s["agentId"], s["agent_id"]).alias("agent"), F.coalesce(meta & F.col("sub"), F.lit(False)).alias("subagent"), "sidechain",
        (~F.col("sidechain") & F.coalesce(s["type"].isin("user", "assistant"), F.lit(False))).alias("primary"),
    )
    # runs of lines first, so that no file meets in one task; both steps are aggregates on either side of their shuffle
    of_run = slim.withColumn("run", F.floor(line / RUN_LINES)).groupBy("file_path", "run").agg(
        F.count(F.lit(1)).alias("event_count"), _first(F.col("ts"), line).alias("timestamp"), _last(F.col("ts"), line).alias("last_timestamp"),
        *(_last(F.col(c), line).alias(c) for c in ("own_id", "agent", "direct", "provider", "originator")), _last(F.coalesce("own_id", "meta_id"), line).alias("last_id"),
        F.max(F.when(F.col("direct").isNotNull(), line)).alias("direct_at"), *(F.bool_or(c).alias(c) for c in ("subagent", "sidechain", "primary")),
        F.collect_list(F.when(F.col("other").isNotNull(), F.struct("line_number", "other"))).alias("others"), *(F.first(c).alias(c) for c in given),
    )
    run = F.col("run")
    late = F.array_min(F.filter("others", lambda o: o["line_number"] >= F.coalesce("direct_at", o["line_number"])))["other"]
    of_run = of_run.withColumn("late", late).drop("others")
    facts = of_run.groupBy("file_path").agg(
        F.sum("event_count").alias("event_count"), _first(F.col("timestamp"), run).alias("timestamp"),
        *(_last(F.col(c), run).alias(c) for c in ("last_timestamp", "last_id", "own_id", "agent", "direct", "provider", "originator")),
        F.max("direct_at").alias("direct_at"), *(F.bool_or(c).alias(c) for c in ("subagent", "sidechain", "primary")),
        F.collect_list(F.when(F.col("late").isNotNull(), F.struct("run", "late"))).alias("lates"), *(F.first(c).alias(c) for c in given),
    )
    facts = facts.withColumnRenamed("own_id", "parent").withColumn("other", F.array_min(F.filter("lates", lambda x: F.coalesce(x["run"] >= F.floor(F.col("direct_at") / RUN_LINES), F.lit(True))))["late"])
    below = F.col("file_path").rlike(r"(^|[/\\])subagents([/\\]|$)")
    stem = F.regexp_replace(T.basename(F.col("file_path")), r"(?<=.)\.[^.]*$", "")
    some = lambda c, other: F.coalesce(T.blank_to_null(F.col(c)), other)
    hidden = F.col("subagent") | below | (F.col("sidechain") & ~F.col("primary"))
    return facts.select(
        "file_path", *given,
        F.when(below, F.concat(some("parent", F.lit("unknown")), F.lit(":subagent:"), some("agent", stem))).otherwise(F.coalesce("last_id", stem)).alias("id"),
        "timestamp", "last_timestamp", F.coalesce(T.blank_to_null(F.col("direct")), "other", F.lit("")).alias("cwd"),
        F.coalesce("provider", F.lit("unknown")).alias("model_provider"), F.coalesce("originator", F.lit("")).alias("originator"), "event_count",
        hidden.alias("hidden"), F.when(hidden, "subagent").otherwise("").alias("hidden_reason"), F.when(below, T.blank_to_null(F.col("parent"))).alias("parent_session_id"),
    )


def message_facts(messages: DataFrame) -> DataFrame:
    """Per file: message_count, context_count, role_counts, tool_count, first_user, first_assistant, first_message.

    Context counts apart and gives no title. Roles are counted before they're gathered: a map has one entry a role.
    """
    own, order = ~F.col("synthetic_context"), F.col("ord")
    title = F.when(own & (F.col("role") == "user"), T.blank_to_null(T.compact_title(F.col("text"), TITLE_CHARS)))
    short = T.blank_to_null(T.compact(F.col("text"), PREVIEW_CHARS))
    by_role = messages.groupBy("file_path", "role").agg(
        F.count_if(own).alias("own"), F.count_if(~own).alias("context"), F.min(F.when(title.isNotNull(), F.struct(order, title.alias("t")))).alias("u"),
        F.min(F.when(own & (F.col("role") == "assistant") & short.isNotNull(), F.struct(order, short.alias("t")))).alias("a"),
        F.min(F.when(own & short.isNotNull(), F.struct(order, short.alias("t")))).alias("m"),
    )
    entries = F.sort_array(F.collect_list(F.when(F.col("own") > 0, F.struct("role", "own"))))
    return by_role.groupBy("file_path").agg(
        F.sum("own").alias("message_count"), F.sum("context").alias("context_count"), F.map_from_entries(entries).alias("role_counts"),
        F.coalesce(F.sum(F.when(F.col("role") == "tool", F.col("own"))), F.lit(0)).alias("tool_count"),
        F.min("u")["t"].alias("first_user"), F.min("a")["t"].alias("first_assistant"), F.min("m")["t"].alias("first_message"),
    )


def apply_format_defaults(df: DataFrame) -> DataFrame:
    """Provider and originator of the source's format where the records name none."""
    provider, originator = F.col("model_provider"), F.col("originator")
    for kind, (p, o) in DEFAULTS.items():
        own = F.col("source_kind") == kind
        provider = F.when(own & (F.col("model_provider") == "unknown"), p).otherwise(provider)
        originator = F.when(own & (F.col("originator") == ""), o).otherwise(originator)
    return df.withColumns({"model_provider": provider, "originator": originator})


def summarize_records(records: DataFrame, messages: DataFrame) -> DataFrame:
    """A summary of each transcript file that has a record. `records` may carry source_kind, display_source, archived and
    root_rank, the same on all rows of a file; other columns aren't read."""
    given = {"source_kind": F.lit("codex"), "display_source": F.lit(""), "archived": F.lit(False), "root_rank": F.lit(0)}
    told = records.withColumns({n: c for n, c in given.items() if n not in records.columns})
    out = record_facts(told, tuple(given)).join(message_facts(messages), "file_path", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("message_count", "context_count", "tool_count")}
    out = apply_format_defaults(out.withColumns(zero))
    return out.select(
        F.concat_ws(":", "source_kind", "id").alias("session_key"), "id", "source_kind", "display_source", "timestamp", "last_timestamp", "model_provider", "cwd",
        F.when(F.col("hidden"), "subagent").otherwise("cli").alias("source"), "originator", "file_path", "event_count", "message_count", "context_count", "tool_count",
        F.coalesce("role_counts", F.create_map().cast("map<string,bigint>")).alias("role_counts"),
        F.coalesce("first_user", T.basename(F.col("cwd")), "id").alias("title"), F.coalesce("first_assistant", "first_message", F.lit("")).alias("preview_text"),
        "archived", F.when(F.col("archived"), "codex").otherwise("").alias("archive_source"), "hidden", "hidden_reason", "parent_session_id", "root_rank",
    )


def search_head(c: str = "") -> Column:
    """The lines of a summary that its search document begins with."""
    return F.concat_ws("\n", *(F.col(f"{c}{f}") for f in SEARCH_FIELDS))


def enrich_history(legacy: DataFrame, history: DataFrame) -> DataFrame:
    """Session documents with their lines of the prompt history: first and last time, history_events and history_messages.

    `legacy`: id, timestamp and what else it has. `history`: id, line_number, timestamp, display. Lines are reduced to a
    row per session before the join. A session's own time stays the first; the last line's time is the last. A display
    that isn't there gives an event, but no message.
    """
    line, ts = F.col("line_number"), T.blank_to_null(F.col("timestamp"))
    shown = T.strip(F.coalesce("display", F.lit("")))
    per = history.where("id IS NOT NULL").groupBy("id").agg(
        _first(ts, line).alias("_first"), _last(ts, line).alias("_last"), F.count(F.lit(1)).alias("history_events"),
        F.count("display").alias("history_messages"), _first(T.blank_to_null(T.compact_title(shown, TITLE_CHARS)), line).alias("history_title"),
    )
    own = T.blank_to_null(F.col("timestamp"))
    out = legacy.join(per, "id", "left").withColumn("last_timestamp", F.coalesce("_last", own)).withColumn("timestamp", F.coalesce(own, "_first"))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("history_events", "history_messages")}).drop("_first", "_last")


def resolve_keys(summaries: DataFrame, keys: DataFrame) -> DataFrame:
    """key, session_key: a key is a session's whole key, or else its bare id where only one session has that."""
    exact = keys.join(summaries.select(F.col("session_key").alias("key")), "key", "left_semi").select("key", F.col("key").alias("session_key"))
    bare = summaries.groupBy(F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("session_key").alias("session_key")).where("n = 1").drop("n")
    return exact.unionByName(keys.join(exact, "key", "left_anti").join(bare, "key"))


def link_parents(summaries: DataFrame) -> DataFrame:
    """session_key, parent_key of every session that names a parent; null where no such session of the kind is there."""
    parents = summaries.groupBy("source_kind", F.col("id").alias("parent_session_id")).agg(F.min("session_key").alias("parent_key"))
    return summaries.where("parent_session_id IS NOT NULL").join(parents, ["source_kind", "parent_session_id"], "left").select("session_key", "parent_key")


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources in one table, in order of priority: the place in the list is root_rank."""
    ranked = [s.withColumn("root_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def first_session_wins(summaries: DataFrame) -> DataFrame:
    """Of sessions with one key, that of the first root."""
    return query.first_root_wins(summaries.withColumn("role_counts", F.to_json("role_counts")), ["session_key"], ["root_rank", "file_path"])


def sources(records: DataFrame) -> DataFrame:
    """source_kind and display_source of the kinds present; of several roots of a kind the first names it."""
    return records.groupBy("source_kind").agg(F.min_by("display_source", "root_rank").alias("display_source"), F.min("root_rank").alias("root_rank"))


def merge_summaries(partials: DataFrame) -> DataFrame:
    """One row per session from the summaries of its part in each file.

    `partials`: id, file_path, timestamp, last_timestamp, cwd, model_provider, originator, event_count, message_count,
    context_count, role_counts, first_user, first_assistant, first_message. Parts are ordered by time, then file; times of
    a session compare as instants if all of them are, else as text; an empty one comes first. The earliest time that isn't
    empty gives the file. Of working directories, providers and originators the last that is known stays; of first texts
    the first. Counts are added, by role too. All is aggregated on both sides of the shuffle; a session's parts never meet
    in one group.
    """
    some = lambda c: T.blank_to_null(F.col(c))
    instant = lambda c: F.when(some(c).rlike(T.RFC3339), F.try_to_timestamp(some(c)))
    path = F.coalesce("file_path", F.lit(""))
    rows = partials.withColumns({"_t": instant("timestamp"), "_l": instant("last_timestamp")})
    rows = rows.withColumns({"_by_time": F.struct("_t", path.alias("p")), "_by_text": F.struct(F.coalesce("timestamp", F.lit("")).alias("t"), path.alias("p"))})
    sound = F.bool_and((some("timestamp").isNull() | F.col("_t").isNotNull()) & (some("last_timestamp").isNull() | F.col("_l").isNotNull()))
    either = lambda f: F.when(sound, f(F.col("_by_time"))).otherwise(f(F.col("_by_text")))
    earliest = lambda value, has: either(lambda o: F.min_by(value, F.when(has.isNotNull(), o)))
    latest = lambda has: either(lambda o: F.max_by(has, F.when(has.isNotNull(), o)))
    known = F.nullif(some("model_provider"), F.lit("unknown"))
    last = F.when(sound, F.max_by(some("last_timestamp"), F.struct("_l", "last_timestamp"))).otherwise(F.max("last_timestamp"))
    out = rows.groupBy("id").agg(
        F.coalesce(earliest(some("file_path"), some("timestamp")), either(lambda o: F.min_by(some("file_path"), F.when(some("file_path").isNotNull(), o)))).alias("file_path"),
        earliest(some("timestamp"), some("timestamp")).alias("timestamp"), T.blank_to_null(last).alias("last_timestamp"),
        F.coalesce(latest(some("cwd")), F.lit("")).alias("cwd"), F.coalesce(latest(known), F.lit("unknown")).alias("model_provider"), F.coalesce(latest(some("originator")), F.lit("")).alias("originator"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("event_count", "message_count", "context_count")),
        *(earliest(some(c), some(c)).alias(c) for c in ("first_user", "first_assistant", "first_message")), F.count(F.lit(1)).alias("files"),
    )
    roles = partials.select("id", F.explode("role_counts").alias("role", "n")).groupBy("id", "role").agg(F.sum("n").alias("n"))
    summed = roles.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "n")))).alias("role_counts"))
    return out.join(summed, "id", "left").withColumn("role_counts", F.coalesce("role_counts", F.create_map().cast("map<string,bigint>")))


def merge_search_texts(partials: DataFrame, cap: int = 64_000, run_rows: int | None = ordered.RUN_ROWS) -> DataFrame:
    """id, search_text of each session: the search texts of its parts in the order of `merge_summaries`, a newline after each, up
    to `cap` bytes of whole characters. `partials`: id, file_path, timestamp, last_timestamp, search_text."""
    some = lambda c: T.blank_to_null(F.col(c))
    instant = lambda c: F.when(some(c).rlike(T.RFC3339), F.try_to_timestamp(some(c)))
    sound = F.bool_and((some("timestamp").isNull() | instant("timestamp").isNotNull()) & (some("last_timestamp").isNull() | instant("last_timestamp").isNotNull()))
    by_id = partials.groupBy("id").agg(sound.alias("_sound"))
    rows = partials.select("id", "search_text", instant("timestamp").alias("_t"), F.coalesce("timestamp", F.lit("")).alias("_s"), F.coalesce("file_path", F.lit("")).alias("_p")).join(by_id, "id")
    rows = rows.withColumns({"_t": F.when(F.col("_sound"), F.col("_t")), "_s": F.when(~F.col("_sound"), F.col("_s"))})
    return ordered.joined_text(rows, "id", ["_t", "_s", "_p"], ["search_text"], cap, run_rows).withColumnRenamed("joined", "search_text")
