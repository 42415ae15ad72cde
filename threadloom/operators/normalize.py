"""From raw records to messages and events: record routing, content blocks, tool calls and results, context markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import variants as V
from threadloom.functions.text import strip
from threadloom.operators.ordered import drop_mirrored, numbered, resolve_tool_names
from threadloom.schemas import Columns
from threadloom.sources.shared import new_path

#: How a user's text begins that a client has put there as context.
MARKERS = (
    "<recommended_plugins", "<permissions instructions", "<app-context", "<collaboration_mode", "<environment_context",
    "<skills_instructions", "<apps_instructions", "<plugins_instructions", "# agents.md instructions", "# files mentioned by the user:",
)

#: The role that a record's subtype means.
ROLES = {
    "user": ("user", "user_message"),
    "assistant": ("assistant", "agent_message", "model"),
    "tool": ("tool_use", "tool_result", "tool_call", "function_call", "function_call_output"),
    "system": ("error", "result"),
}
CALLS = ("function_call", "tool_call", "tool_use")

MESSAGES = Columns("file_path", ("line_number", "block"), "role", "text", "timestamp", "source_type")


def is_context(role: Column, text: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """Whether a message is context and not conversation: a developer's, or a user's that begins with a marker."""
    start = F.lower(strip(text))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.startswith(start, F.lit(m))
    return F.coalesce((role == "developer") | ((role == "user") & marked), F.lit(False))


def blocks(records: DataFrame) -> DataFrame:
    """Candidate messages, in one pass over the records: a row for each content block of a user's or assistant's message,
    and one for each record of another kind. A null text gives no message.

    Steps are selects of their own, so that none gives code too long to be compiled.
    """
    r, s, f, t = (F.col(c) for c in ("record", "s", "f", "t"))
    rows = records.where("record IS NOT NULL").select("file_path", "line_number", "record", V.strings_at(r, "$.type", "$.timestamp", "$.subtype", "$.role", "$.message.role").alias("s"), V.at(r, "$.message").alias("m"))
    own = F.coalesce(s[0].isin("user", "assistant"), F.lit(False)) & V.is_kind(F.col("m"), "OBJECT")
    rows = rows.select("*", own.alias("own"), V.at(F.col("m"), "$.content").alias("content"))
    own, content = F.col("own"), F.col("content")
    items = F.when(own & V.is_kind(content, "ARRAY"), F.try_variant_get(content, "$", "array<variant>")).otherwise(F.array(F.when(own, content)))
    outer = F.when(~own, F.coalesce(V.at(r, "$.payload"), r))
    rows = rows.select("*", outer.alias("p"), (own & (V.true_at(r, "$.isMeta") | V.true_at(r, "$.isSidechain"))).alias("context"), V.true_at(r, "$.is_error").alias("failed"))
    rows = rows.withColumn("m", F.when(~own, F.coalesce("m", V.at(F.col("p"), "$.message"), "p"))).select("*", F.posexplode(items).alias("block", "b"))
    b, p, m = F.col("b"), F.col("p"), F.col("m")
    fields = F.when(own, V.strings_at(b, "$", "$.type", "$.name", "$.id", "$.tool_use_id")).otherwise(V.strings_at(p, "$.type", "$.message", "$.output", "$.arguments", "$.name", "$.tool_name", "$.call_id", "$.tool_use_id", "$.id"))
    rows = rows.withColumns({"f": fields, "said": V.string_at(m, "$.role")})
    inside = F.array(F.when(f[1] == "tool_result", V.at(b, "$.content")).otherwise(b))
    around = F.array(F.coalesce(V.at(m, "$.content"), m), F.coalesce(V.at(p, "$.content"), p), V.at(r, "$.result"), V.at(r, "$.error"))
    rows = rows.withColumn("t", V.extract_texts(F.when(own, inside).otherwise(around)))
    rows = rows.select(
        "file_path", "line_number", "block", "own", "s", "f", "t", "said", "context", "failed", F.coalesce(s[0], F.lit("unknown")).alias("source_type"),
        F.when(own & (f[1] == "tool_use"), V.json_or_null(V.at(b, "$.input"))).when(own & (f[1] == "tool_result"), V.json_or_null(V.at(b, "$.content"))).alias("json"),
        (own & V.true_at(b, "$.is_error")).alias("block_failed"),
    )
    of_block, of_record = _block_fields(s, f, t), _record_fields(s, f, t)
    subtype = F.when(own, of_block.pop("source_subtype")).otherwise(of_record.pop("source_subtype"))
    rows = rows.withColumn("source_subtype", subtype).withColumns({c: F.when(own, of_block[c]).otherwise(of_record[c]) for c in ("role", "own_name")})
    rest = [c for c in of_block if c not in ("role", "own_name")]
    stamp = F.nullif(s[1], F.lit("")).alias("timestamp")
    return rows.select("file_path", "line_number", "block", stamp, "source_type", "source_subtype", "role", "own_name", "context", *(F.when(own, of_block[c]).otherwise(of_record[c]).alias(c) for c in rest))


def _block_fields(s: Column, f: Column, t: Column) -> dict[str, Column]:
    """Fields of one content block. f: itself if it's a string, its type, name, id and tool_use_id."""
    kind, name = f[1], F.coalesce(f[2], F.lit("unknown_tool"))
    call = F.concat(F.lit("["), name, F.lit("] "), F.col("json"))
    id_ = F.when(kind == "tool_use", f[3]).when(kind == "tool_result", f[4])
    is_ = lambda *kinds: F.coalesce(kind.isin(*kinds), F.lit(False))
    return {
        "source_subtype": F.coalesce(kind, F.lit("text")),
        "role": F.when(is_("tool_use", "tool_result"), "tool").when(is_("thinking"), "assistant").otherwise(F.coalesce(s[4], s[0])),
        "own_name": F.when(is_("tool_use"), name),
        "text": F.when(is_("tool_use"), call).when(is_("tool_result"), F.coalesce(t[0], "json")).otherwise(F.coalesce(f[0], F.when(kind.isNotNull(), t[0]))),
        "thinking": is_("thinking"),
        "blank_stays": is_("tool_use", "tool_result"),
        "tool_kind": F.when(is_("tool_use"), "tool_call").when(is_("tool_result"), "tool_result"),
        "tool_call_id": F.nullif(id_, F.lit("")),
        "names_call": is_("tool_use"),
        "is_error": is_("tool_result") & F.col("block_failed"),
    }


def _record_fields(s: Column, f: Column, t: Column) -> dict[str, Column]:
    """Fields of a record without content blocks. f: strings of its payload."""
    type_, subtype, role = F.col("source_type"), F.col("source_subtype"), F.col("role")
    outcome, no = type_.isin("result", "system"), F.lit(False)
    by_type = F.when(outcome, "system")
    for name, subtypes in ROLES.items():
        by_type = by_type.when(subtype.isin(*subtypes), name)
    return {
        "source_subtype": F.when(outcome, F.coalesce(s[2], type_)).otherwise(F.coalesce(f[0], type_)),
        "role": F.coalesce(F.col("said"), s[3], by_type.otherwise("unknown")),
        "own_name": F.coalesce(f[4], f[5]),
        "text": F.coalesce(t[0], t[1], f[1], f[2], f[3], t[2], t[3]),
        "thinking": no,
        "blank_stays": no,
        "tool_kind": F.when(role == "tool", subtype),
        "tool_call_id": F.coalesce(f[6], f[7], f[8]),
        "names_call": subtype.isin(*CALLS) & F.col("own_name").isNotNull(),
        "is_error": (subtype == "error") | F.col("failed") | ((type_ == "result") & F.startswith(subtype, F.lit("error"))) | ((type_ == "system") & F.contains(subtype, F.lit("error"))),
    }


def normalize(records: DataFrame, *, markers: tuple[str, ...] = MARKERS, run_rows: int | None = None) -> DataFrame:
    """Messages of records (file_path, line_number, record), in the order of file_path, ord.

    Mirrored records are dropped. A tool's result, and a later call without a name, take the name of the latest earlier
    call with their id in the file. Records that are no JSON (null) and blank texts give no message; other columns of the
    records aren't read.

    A file's messages are shuffled once, by file, and its rows are one task's. With run_rows none is more than a run's:
    messages are written to the shared folder first, and files of more rows than that are scanned in runs.
    """
    found = blocks(records)
    no_id = F.concat_ws("\u0000", F.lit(""), F.col("line_number").cast("string"), F.col("block").cast("string"))
    found = found.withColumns({"_call": F.coalesce("tool_call_id", no_id), "_names": F.when(F.col("names_call"), F.col("own_name"))})
    if run_rows is None:
        found = found.repartition("file_path")  # all windows below are of a file, or within one
    else:
        path = new_path(records.sparkSession, "messages")
        found.write.parquet(path)
        found = records.sparkSession.read.schema(found.schema).parquet(path)
    place = ["line_number", "block"]
    named = resolve_tool_names(found, "file_path", "_call", place, F.col("_names"), run_rows)
    result = F.col("tool_kind").eqNullSafe(F.lit("tool_result")) & F.col("blank_stays")
    name = F.coalesce("own_name", F.when(F.col("tool_call_id").isNotNull(), F.col("resolved")), F.when(result, F.coalesce("tool_call_id", F.lit("tool_result"))))
    named = named.withColumn("tool_name", name).where(F.col("blank_stays") | (strip(F.coalesce("text", F.lit(""))) != ""))
    shown = named.withColumn("text", strip(F.col("text"))).withColumn("synthetic_context", F.col("context") | F.col("thinking") | is_context(F.col("role"), F.col("text"), markers))
    kept = numbered(drop_mirrored(shown, MESSAGES, run_rows=run_rows), ["file_path"], place, run_rows)
    in_record = Window.partitionBy("file_path", "line_number").orderBy("block")
    return kept.select(
        "file_path", "line_number", (F.row_number().over(in_record) - 1).alias("message_index"), "ord", "role", "text",
        "timestamp", "source_type", "source_subtype", "synthetic_context", "tool_name", "tool_kind", "tool_call_id", "is_error",
    )


def truncate_messages(messages: DataFrame, max_chars: int = 20_000) -> DataFrame:
    """Texts of at most max_chars characters, with text_truncated and original_text_chars (null where nothing is cut)."""
    n = F.length("text")
    return messages.withColumns({"text": F.left("text", F.lit(max_chars)), "text_truncated": F.coalesce(n > max_chars, F.lit(False)), "original_text_chars": F.when(n > max_chars, n.cast("long"))})


def events(records: DataFrame, max_payload_chars: int = 10_000) -> DataFrame:
    """file_path, line_number, timestamp, type, payload, payload_truncated, original_chars of every record; a line that is
    no JSON is a parse_error. The payload (JSON text) of a line that is too long is left out. Records without lines (no column
    raw), such as elements of arrays, are as long as their JSON."""
    if "raw" not in records.columns:
        records = records.withColumn("raw", F.to_json("record"))
    r, n = F.col("record"), F.length("raw")
    long = F.coalesce(n > max_payload_chars, F.lit(False))
    payload = F.when(r.isNull(), F.to_json(F.struct(F.col("raw").alias("raw_line")))).when(~long, F.to_json(F.coalesce(V.at(r, "$.payload"), r)))
    return records.select(
        "file_path", "line_number", F.nullif(V.string_at(r, "$.timestamp"), F.lit("")).alias("timestamp"),
        F.when(r.isNull(), "parse_error").otherwise(F.coalesce(V.string_at(r, "$.type"), F.lit("unknown"))).alias("type"), payload.alias("payload"),
        (long & r.isNotNull()).alias("payload_truncated"), F.when(long & r.isNotNull(), n.cast("long")).alias("original_chars"),
    )
