"""Operators that depend on the order of a session's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.runs import RUN_ROWS, carry, in_runs
from threadloom.schemas import Columns


def drop_mirrored(df: DataFrame, m: Columns, pair: tuple[str, str] = ("event_msg", "response_item"), run_rows: int | None = RUN_ROWS) -> DataFrame:
    """Drop a message that repeats the last kept one's role and text, where the two types are the pair.

    Runs of equal role and text whose types are both in the pair form islands; in an island the rows of the first row's
    type stay. A long session's run takes from earlier ones what the last row was, and the first type of its island.
    """
    rows, cut = in_runs(df, [m.session], list(m.order), run_rows)
    within = [m.session, "_run"] if cut else [m.session]
    w = Window.partitionBy(*within).orderBy(*m.order)
    now, inside = F.struct(m.role, m.text), F.col(m.kind).isin(*pair)
    starts = ~F.coalesce((F.lag(now).over(w) == now) & F.lag(inside).over(w) & inside, F.lit(False))
    marked = rows.withColumn("_starts", starts)
    if cut:
        here = F.struct(F.col(m.role).alias("role"), F.sha2(F.col(m.text).cast("string").cast("binary"), 256).alias("text"), inside.alias("inside"))
        place = F.struct(*m.order)
        marked = carry(marked.withColumn("_here", here), [m.session], {"_last_here": F.max_by("_here", place)}, {"_before": (F.last("_last_here"), True)})
        again = (F.col("_before.role").eqNullSafe(F.col("_here.role"))) & (F.col("_before.text").eqNullSafe(F.col("_here.text"))) & F.col("_before.inside") & F.col("_here.inside")
        first_row = F.row_number().over(w) == 1
        marked = marked.withColumn("_starts", F.when(first_row, ~F.coalesce(again, F.lit(False))).otherwise(F.col("_starts")))
    marked = marked.withColumn("_island", F.sum(F.col("_starts").cast("long")).over(w))
    first = F.first(m.kind).over(Window.partitionBy(*within, "_island").orderBy(*m.order))
    if cut:
        begun = F.max_by(F.when(F.col("_starts"), F.col(m.kind)), F.when(F.col("_starts"), F.struct(*m.order)))
        marked = carry(marked, [m.session], {"_begun": begun, "_any": F.max("_starts")}, {"_first_before": (F.last(F.when(F.col("_any"), F.struct("_begun")), ignorenulls=True), True)})
        first = F.when(F.col("_island") > 0, first).otherwise(F.col("_first_before._begun"))
    return marked.withColumn("_first", first).where(F.col(m.kind) == F.col("_first")).select(*df.columns)


def numbered(df: DataFrame, keys: list[str], order: list[str], run_rows: int | None = RUN_ROWS) -> DataFrame:
    """`ord` (1, 2, … along the session) and `total` of every row."""
    rows, cut = in_runs(df, keys, order, run_rows)
    w = Window.partitionBy(*keys, "_run") if cut else Window.partitionBy(*keys)
    out = rows.withColumn("ord", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("total", F.count(F.lit(1)).over(w))
    if cut:
        out = carry(out, keys, {"_n": F.count(F.lit(1))}, {"_before": (F.sum("_n"), True), "_all": (F.sum("_n"), False)})
        out = out.withColumns({"ord": F.col("ord") + F.coalesce("_before", F.lit(0)), "total": F.coalesce("_all", "total")}).drop("_before", "_all")
    return out.drop("_run")


def head_tail(df: DataFrame, m: Columns, n: int, run_rows: int | None = RUN_ROWS) -> DataFrame:
    """The first half (rounded up) and last half of n rows of each session, with ord, total and omitted."""
    out = numbered(df, [m.session], list(m.order), run_rows)
    head, tail = (n + 1) // 2, n // 2
    return out.where((F.col("ord") <= head) | (F.col("ord") > F.col("total") - tail)).withColumn("omitted", F.greatest(F.col("total") - n, F.lit(0)).cast("long"))


def mark_omitted(shown: DataFrame, m: Columns, n: int, marker: dict[str, Column]) -> DataFrame:
    """Rows of `head_tail` with is_truncation_marker and omitted_count, and a row more for each session that lost some, in
    their place: `marker` tells its columns, omitted_count how many they are; it is null elsewhere, as other columns are there."""
    at = F.lit((n + 1) // 2 + 1).cast("long")
    own = {m.session: F.col(m.session), "ord": at, "total": F.col("total"), "omitted": F.col("omitted"), **marker}
    row = shown.where((F.col("omitted") > 0) & (F.col("ord") == 1)).select(*(own.get(c, F.lit(None)).cast(shown.schema[c].dataType).alias(c) for c in shown.columns), F.lit(True).alias("is_truncation_marker"), F.col("omitted").alias("omitted_count"))
    return shown.withColumns({"is_truncation_marker": F.lit(False), "omitted_count": F.lit(None).cast("long")}).unionByName(row)


def resolve_tool_names(df: DataFrame, session: str, call_id: str, order: list[str], name: Column, run_rows: int | None = RUN_ROWS) -> DataFrame:
    """`resolved`: the name of the latest earlier call of the same id; null without one."""
    keys = [session, call_id]
    rows, cut = in_runs(df.withColumn("_name", name), keys, order, run_rows)
    w = Window.partitionBy(*keys, "_run") if cut else Window.partitionBy(*keys)
    last = F.last("_name", ignorenulls=True)
    out = rows.withColumn("resolved", last.over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    if cut:
        latest = F.max_by("_name", F.when(F.col("_name").isNotNull(), F.struct(*order)))
        out = carry(out, keys, {"_latest": latest}, {"_earlier": (F.last("_latest", ignorenulls=True), True)}).withColumn("resolved", F.coalesce("resolved", "_earlier")).drop("_earlier")
    return out.drop("_name", "_run")


#: Scan partitions whose first numbers are looked up in a broadcast table, some forty bytes each: 100 TB have 0.8 million.
MOST_SPLITS = 4_000_000


def number_lines(df: DataFrame) -> DataFrame:
    """line_number in each file of a text scan (file_path, block_start and what else it has), whose splits come in order of
    their start.

    Lines of a split are counted first, and the counts summed up by file: one row for each split. Then every line has its
    place in the split, where it lies, and the split's first number, looked up by scan partition: lines aren't shuffled, and
    no file is ever sorted in one task. The scan is read twice, and the same both times; `df` must be a scan with nothing but
    selections above it.
    """
    at = ["file_path", "block_start"]
    placed = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    splits = placed.groupBy(*at).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = splits.select(F.shiftright("_first", 33).alias("_part"), F.struct("_first", (before + 1 - F.col("_first")).alias("_shift")).alias("_s"))
    of_part = shifts.groupBy("_part").agg(F.array_sort(F.collect_list("_s")).alias("_splits"))  # the splits that one task reads
    if df.rdd.getNumPartitions() <= MOST_SPLITS:
        of_part = F.broadcast(of_part)
    own = F.element_at(F.filter("_splits", lambda x: x["_first"] <= F.col("_id")), -1)["_shift"]
    return placed.join(of_part, "_part").withColumn("line_number", F.col("_id") + own).select(*df.columns, "line_number")


def day_groups(df: DataFrame, day: Column, today: str) -> DataFrame:
    """`day_label` (today, yesterday, the day, unknown) and `group_size`."""
    groups = df.groupBy(day.alias("_d")).agg(F.count(F.lit(1)).alias("group_size"))
    out = df.withColumn("_day", day).join(groups, F.col("_day").eqNullSafe(F.col("_d")))
    yesterday = F.date_format(F.date_sub(F.lit(today).cast("date"), 1), "yyyy-MM-dd")
    label = F.when(F.col("_day").isNull(), "unknown").when(F.col("_day") == today, "today").when(F.col("_day") == yesterday, "yesterday").otherwise(F.col("_day"))
    return out.withColumn("day_label", label).drop("_d", "_day")


def contiguous_prefix(df: DataFrame, key: str, idx: str) -> DataFrame:
    """Fragments 0, 1, 2, … up to the first gap."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(idx)) - 1).where(F.col("_n") == F.col(idx)).drop("_n")


def search_document(df: DataFrame, m: Columns, cap: int, run_rows: int | None = RUN_ROWS) -> DataFrame:
    """session, document: role and text of its rows, a newline after each, up to `cap` bytes of whole characters."""
    return joined_text(df, m.session, list(m.order), [m.role, m.text], cap, run_rows).withColumnRenamed("joined", "document")


def joined_text(df: DataFrame, session: str, by: list[str], texts: list[str], cap: int, run_rows: int | None = RUN_ROWS) -> DataFrame:
    """session, joined: the columns `texts` of its rows, one after another and a newline after each, up to `cap` bytes of whole
    characters. A null text is an empty one."""
    order = [f"_o{i}" for i in range(len(by))]
    lines = df.select(session, F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts)).alias("_lines"), *(F.col(c).alias(o) for c, o in zip(by, order, strict=True)))
    rows, cut = in_runs(lines, [session], order, run_rows)
    w = (Window.partitionBy(session, "_run") if cut else Window.partitionBy(session)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.transform("_lines", lambda x: F.octet_length(x).cast("long") + 1)
    placed = rows.withColumn("_size", F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("before", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    if cut:
        placed = carry(placed, [session], {"_bytes": F.sum("_size")}, {"_earlier": (F.sum("_bytes"), True)}).withColumn("before", F.col("before") + F.coalesce("_earlier", F.lit(0)))
    # what the cap leaves of a row's lines; rows beyond it are never collected
    kept = placed.where(F.col("before") < cap).select(session, "before", F.posexplode("_lines").alias("part", "value"), sizes.alias("_sizes"))
    kept = kept.withColumn("before", F.col("before") + F.aggregate(F.slice("_sizes", F.lit(1), F.col("part")), F.lit(0).cast("long"), lambda a, x: a + x)).where(F.col("before") < cap)
    kept = kept.withColumn("value", T.clip_bytes(F.col("value"), (F.lit(cap) - F.col("before")).cast("int")))
    both = F.array_sort(F.collect_list(F.struct("before", "value")))  # bounded by the cap
    return kept.groupBy(session).agg(F.array_join(F.transform(both, lambda x: F.concat(x["value"], F.lit("\n"))), "").alias("joined"))


def whole_search_document(summaries: DataFrame, bodies: DataFrame, head: Column, cap: int) -> DataFrame:
    """session_key, document: the head of a summary, then what the cap in bytes leaves of its body (session_key, document:
    `search_document` of messages that aren't context), and a newline. A head that fills the cap stays whole, alone."""
    room = F.lit(cap) - F.octet_length("_head")
    joined = summaries.select("session_key", head.alias("_head")).join(bodies, "session_key", "left")
    body = F.concat(T.clip_bytes(F.coalesce("document", F.lit("")), room.cast("int")), F.lit("\n"))
    return joined.select("session_key", F.when(room > 0, F.concat("_head", body)).otherwise(F.col("_head")).alias("document"))


def summarize(df: DataFrame, m: Columns, title_chars: int = 80) -> DataFrame:
    """One row per session: counts, counts by role, title (first user text), preview (first assistant text) and first_user."""
    order = F.struct(*m.order)
    filled = T.squeeze(F.col(m.text)) != ""
    first = lambda role: F.min_by(F.when(filled & (F.col(m.role) == role), F.col(m.text)), F.when(filled & (F.col(m.role) == role), order))
    roles = {r: F.count_if(F.col(m.role) == r).alias(f"{r}_count") for r in ("user", "assistant", "system", "tool")}
    out = df.groupBy(m.session).agg(F.count(F.lit(1)).alias("message_count"), *roles.values(), first("user").alias("_t"), first("assistant").alias("_p"), F.min_by(m.text, order).alias("_f"))
    title = T.compact_title(F.coalesce("_t", F.lit("")), title_chars)
    return out.withColumn("title", F.coalesce(T.blank_to_null(title), F.col(m.session).cast("string"))).withColumn("preview", T.compact(F.coalesce("_p", "_f", F.lit("")), 160)).withColumn("first_user", F.col("_t")).drop("_t", "_p", "_f")


def role_histogram(df: DataFrame, m: Columns) -> DataFrame:
    return df.groupBy(m.session, m.role).agg(F.count(F.lit(1)).alias("n"))


def first_and_last(df: DataFrame, session: str, order: list[str], value: str) -> DataFrame:
    """session, lowest (the least value), first and last (the values at either end of the order)."""
    o = F.struct(*order)
    return df.groupBy(session).agg(F.min(value).alias("lowest"), F.min_by(value, o).alias("first"), F.max_by(value, o).alias("last"))


def merge_partials(df: DataFrame, session: str, file: str, ts: str, value: str) -> DataFrame:
    """Per session from per-file partials: files, first and last time, the file of the first, rows and sum."""
    part = df.groupBy(session, file).agg(F.min(ts).alias("a"), F.max(ts).alias("b"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    return part.groupBy(session).agg(F.count(F.lit(1)).alias("files"), F.min_by(file, F.struct("a", file)).alias("primary_file"), F.min("a").alias("first"), F.max("b").alias("last"), F.sum("n").alias("rows"), F.sum("v").alias("total"))


def order_cross_file(df: DataFrame, session: str, keys: list[str], n: int, run_rows: int | None = RUN_ROWS, *, expected: str | None = None) -> DataFrame:
    """The first half (rounded up) and last half of n records of each session, ordered across its files by `keys`, with
    ord, total and omitted. expected: a column with how many records the session's summary has counted; the total is that
    number or that of the records seen, whichever is larger."""
    out = head_tail(df, Columns(session, tuple(keys)), n, run_rows)
    if expected is None:
        return out
    shown, total = F.least("total", F.lit(n)), F.greatest("total", F.coalesce(expected, F.lit(0)))
    return out.withColumn("omitted", (total - shown).cast("long")).withColumn("total", total.cast("long"))
