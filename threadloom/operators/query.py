"""Filters, search, pages, facets and statistics over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.schemas import Columns


def filter_sessions(df: DataFrame, *, provider: str = "", source_kind: str = "", cwd: str = "", date: str = "", day: Column | None = None, show_archived: bool | str = False, show_hidden: bool | str = False, names: dict[str, str] | None = None) -> DataFrame:
    """Equality filters (empty: none), a day prefix, and archived or hidden sessions left out unless asked for, by True or
    as a request says it: `1` or `true`, nothing else. A null flag is none; a null day fails a day filter."""
    n = {"provider": "model_provider", "source_kind": "source_kind", "cwd": "cwd"} | (names or {})
    for want, column in ((provider, n["provider"]), (source_kind, n["source_kind"]), (cwd, n["cwd"])):
        if want:
            df = df.where(F.col(column) == want)
    if date:
        df = df.where(F.startswith(T.local_day(F.col("timestamp")) if day is None else day, F.lit(date)))
    for show, column in ((show_archived, "archived"), (show_hidden, "hidden")):
        if not flag(show) and column in df.columns:
            df = df.where(~F.coalesce(column, F.lit(False)))
    return df


def flag(value: bool | str | None) -> bool:
    """Whether a request's value turns something on."""
    return value in (True, "1", "true")


def search(df: DataFrame, query: str, *, text: str = "search_text", with_snippet: bool = True) -> DataFrame:
    """Rows that contain every term of the query, whatever its case; a query without terms takes all rows."""
    low = F.lower(F.col(text))
    for t in T.terms(query):
        df = df.where(F.contains(low, F.lit(t)))
    return df.withColumn("snippet", T.snippet(F.col(text), query)) if with_snippet else df


def filter_messages(df: DataFrame, m: Columns, *, query: str = "", role: str = "", show_tools: bool = False, show_context: bool = False) -> DataFrame:
    """Messages of a view; `original_index` is their place in the session before filtering."""
    w = Window.partitionBy(m.session).orderBy(*m.order)
    df = df.withColumn("original_index", F.row_number().over(w).cast("long") - 1)
    if not show_tools:
        df = df.where(F.col(m.role) != "tool")
    if not show_context and "synthetic_context" in df.columns:
        df = df.where(~F.col("synthetic_context"))
    if role:
        df = df.where(F.col(m.role) == role)
    return df.where(F.contains(F.lower(m.text), F.lit(query.lower()))) if query else df


def hide_marked(df: DataFrame, marks: DataFrame, on: list[str], *, show: bool = False) -> DataFrame:
    return df if show else df.join(marks.select(*on).distinct(), on, "left_anti")


def page(df: DataFrame, sort: str, key: str, *, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """Rows by sort descending, then key; after a (sort, key) cursor. One row more than the limit tells of a next page."""
    if after is not None:
        df = df.where((F.col(sort) < F.lit(after[0])) | ((F.col(sort) == F.lit(after[0])) & (F.col(key) > F.lit(after[1]))))
    return df.orderBy(F.desc(sort), key).limit(max(1, min(limit, 200)))


def page_after_key(df: DataFrame, sort: str, key: str, *, cursor: str = "", limit: int = 50) -> DataFrame:
    """Rows by sort descending (nulls last), then key, after the row whose key is the cursor: as many as the limit (1 to
    200) says, and one more where a next page follows. A cursor that no row has gives the first page."""
    s, k = F.col(sort), F.col(key)
    if cursor:
        found = df.where(k.cast("string") == cursor).agg(F.max(F.struct(s.alias("s"), k.alias("k"))).alias("_at"))
        at_s, at_k = F.col("_at.s"), F.col("_at.k")
        later = (s < at_s) | (s.isNull() & at_s.isNotNull()) | (s.eqNullSafe(at_s) & (k > at_k))
        df = df.crossJoin(F.broadcast(found)).where(F.col("_at").isNull() | later).drop("_at")  # one row
    return df.orderBy(F.desc(sort), key).limit(max(1, min(limit, 200)) + 1)


def page_object(df: DataFrame, sort: str, key: str, *, cursor: str = "", limit: int = 50) -> DataFrame:
    """One row of a page: keys (in its order), has_more, next_cursor (the last key; null without a next page)."""
    n = max(1, min(limit, 200))
    rows = page_after_key(df, sort, key, cursor=cursor, limit=limit).select(sort, key)
    placed = rows.withColumn("_i", F.row_number().over(Window.partitionBy().orderBy(F.desc(sort), key)))  # at most 201 rows
    one = placed.agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("_i", F.col(key).cast("string").alias("k")))).alias("_all"))
    one = one.select((F.col("_n") > n).alias("has_more"), F.transform(F.slice("_all", 1, n), lambda x: x["k"]).alias("keys"))
    return one.select("keys", "has_more", F.when(F.col("has_more"), F.element_at("keys", -1)).alias("next_cursor"))


def project_list(summaries: DataFrame, *, cwd: str = "cwd", ts: str = "timestamp", provider: str = "model_provider", kind: str = "source_kind") -> DataFrame:
    """path, name, count, last_timestamp ('' if none), providers and source_kinds (sorted, without empty ones) of every
    working directory that isn't empty. Sets are reduced before the shuffle and as small as there are providers."""
    some = lambda c: F.sort_array(F.collect_set(T.blank_to_null(F.col(c)))).alias(f"{c}_set")
    out = summaries.where(F.col(cwd) != "").groupBy(F.col(cwd).alias("path")).agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.max(ts), F.lit("")).alias("last_timestamp"), some(provider), some(kind))
    return out.select("path", F.coalesce(T.basename(F.col("path")), "path").alias("name"), "count", "last_timestamp", F.col(f"{provider}_set").alias("providers"), F.col(f"{kind}_set").alias("source_kinds"))


def newest_projects(projects: DataFrame, n: int = 4) -> DataFrame:
    return projects.orderBy(F.desc("last_timestamp"), "path").limit(n)


def first_root_wins(df: DataFrame, key: list[str], rank: list[str]) -> DataFrame:
    """Of rows with one key, that of the first root. An aggregate, so a hot key is reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in key and c not in rank]
    one = df.groupBy(*key).agg(F.min(F.struct(*rank, *rest)).alias("_r"))
    return one.select(*key, "_r.*").select(*df.columns)


def first_root_of_file(files: DataFrame, *, path: str = "file_path", rank: str = "root_rank") -> DataFrame:
    """Files each once: of rows whose paths are the same place, the one of the first root. A path is compared without its
    scheme, doubled slashes and `.` or `..`; links aren't followed."""
    one = first_root_wins(files.withColumn("_place", T.canonical_path(F.col(path))), ["_place"], [rank, path])
    return one.drop("_place")


def count_by(df: DataFrame, label: str, n: int | None = None) -> DataFrame:
    """label, count: most first, ties by label; empty labels don't count."""
    out = df.where(F.col(label).isNotNull() & (F.col(label).cast("string") != "")).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("count"), "label").limit(n) if n else out


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, value of every distinct non-empty value; distinct is reduced before the shuffle, no set in one task."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).select("p.*").where("value <> ''").distinct()


def projects(df: DataFrame, cwd: str, ts: str, provider: str) -> DataFrame:
    """cwd, sessions, last time, number of providers."""
    return df.groupBy(cwd).agg(F.count(F.lit(1)).alias("sessions"), F.max(ts).alias("last"), F.countDistinct(provider).alias("providers"))


def stats_totals(df: DataFrame, events: Column, day: Column) -> DataFrame:
    """sessions, events, active_days and per_day, sessions per active day with one decimal (ties to even; 0 without any)."""
    out = df.select(events.alias("e"), day.alias("d")).agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("e"), F.lit(0)).alias("events"), F.countDistinct("d").alias("active_days"))
    mean = F.format_string("%.1f", F.bround(F.col("sessions") / F.col("active_days"), 1))
    return out.withColumn("per_day", F.when(F.col("active_days") == 0, "0").otherwise(mean))


def count_by_day(df: DataFrame, day: Column) -> DataFrame:
    """day, n of every day; rows without one don't count."""
    return df.where(day.isNotNull()).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def share_of(counts: DataFrame, n: int = 6) -> DataFrame:
    top = counts.orderBy(F.desc("count"), "label").limit(n)  # a top-n report: at most n rows meet in the window
    return top.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def percent_of_max(counts: DataFrame) -> DataFrame:
    return counts.crossJoin(F.broadcast(counts.agg(F.max("count").alias("_m")))).withColumn("percent", F.floor(100 * F.col("count") / F.col("_m") + 0.5).cast("long")).drop("_m")


def last_n_days(daily: DataFrame, n: int = 14) -> DataFrame:
    return daily.orderBy(F.desc("day")).limit(n).orderBy("day")
