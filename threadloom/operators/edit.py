"""Redaction and relabelling: new snapshots with rows removed or a field changed, never edits in place."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import variants as V
from threadloom.operators import normalize, prompts

#: Providers that come with a client. Neither they nor `custom` are ever relabelled.
BUILTIN = ("amazon-bedrock", "azure", "lmstudio", "ollama", "ollama-chat", "openai", "oss")
PROTECTED = (*BUILTIN, "custom")


def redact_sessions(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def redact_cascade(df: DataFrame, targets: DataFrame, session: str, line: str, call_id: str) -> DataFrame:
    """Rows left once the targets go, and with them every row of the session that shares a call id with one."""
    on = [session, line]
    hit = df.join(targets.select(*on).distinct(), on, "left_semi")
    calls = hit.where(F.col(call_id).isNotNull()).select(session, call_id).distinct()
    return df.join(targets.select(*on).distinct(), on, "left_anti").join(calls, [session, call_id], "left_anti")


def check_references(df: DataFrame, refs: DataFrame, on: list[str], fingerprint: Column) -> tuple[DataFrame, DataFrame]:
    """References whose fingerprint still holds, and the stale ones. `refs`: on, fingerprint."""
    now = df.select(*on, fingerprint.alias("_now"))
    joined = refs.join(now, on, "left").withColumn("_same", F.coalesce(F.col("_now") == F.col("fingerprint"), F.lit(False)))
    return joined.where("_same").select(*on), joined.where("NOT _same").select(*on)


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def provider_census(threads: DataFrame, assignments: DataFrame) -> DataFrame:
    """provider, threads, jsonl: how often each side names it."""
    a = threads.groupBy("provider").agg(F.count(F.lit(1)).alias("threads"))
    b = assignments.groupBy("provider").agg(F.count(F.lit(1)).alias("jsonl"))
    return a.join(b, "provider", "full").select("provider", F.coalesce("threads", F.lit(0)).alias("threads"), F.coalesce("jsonl", F.lit(0)).alias("jsonl"))


def candidate_providers(census: DataFrame, target: str, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    return census.where(~F.col("provider").isin(*protected, target)).select("provider")


def plan_relabel(assignments: DataFrame, sources: list[str], target: str) -> DataFrame:
    """Assignments to change, with what they are and will be: the plan is also the manifest to roll back by."""
    return assignments.where(F.col("provider").isin(sources)).select("path", "line_number", F.col("provider").alias("old"), F.lit(target).alias("new"))


def _planned(rows: DataFrame, plan: DataFrame, at: list[str], now: Column) -> DataFrame:
    """Rows with the plan's old and new. A planned line that isn't there, or has neither its old nor its new provider, fails
    the job: the check is a filter, which no later selection prunes."""
    j = rows.withColumn("_seen", F.lit(True)).join(plan, at, "full")
    stale = F.col("new").isNotNull() & (F.col("_seen").isNull() | ~F.coalesce(now.isin(F.col("old"), F.col("new")), F.lit(False)))
    return j.where(F.when(stale, F.raise_error(F.lit("stale plan")).cast("boolean")).otherwise(F.lit(True))).drop("_seen")


def apply_relabel(assignments: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned lines get the new provider if they still have the old or already the new one. Others, and planned lines that
    are no longer there, fail the job."""
    at = ["path", "line_number"]
    return _planned(assignments, plan, at, F.col("provider")).select(*at, F.coalesce("new", "provider").alias("provider"))


def before_image(records: DataFrame, plan: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """path, line_number, session_id, old, new, record_sha256 and file_sha256 of every planned line as it is before it is
    changed. `records`: file_path, line_number, record. `manifest` (file_path, sha256) gives the files' hashes; null without."""
    r = F.col("record")
    # records are as many as they are, however small their files: a hash of each would be broadcast where these compress well
    out = plan.join(records.select(F.col("file_path").alias("path"), "line_number", r).hint("merge"), ["path", "line_number"], "left")
    out = out.withColumns({"session_id": V.string_at(r, "$.payload.id"), "record_sha256": entry_fingerprint(r)})
    files = manifest.select(F.col("file_path").alias("path"), F.col("sha256").alias("file_sha256")) if manifest is not None else None
    out = out.join(files, "path", "left") if files is not None else out.withColumn("file_sha256", F.lit(None).cast("string"))
    return out.select("path", "line_number", "session_id", "old", "new", "record_sha256", "file_sha256")


def rollback_relabel(assignments: DataFrame, plan: DataFrame) -> DataFrame:
    """path, line_number, provider, conflict: planned lines get the old value back unless they have changed since."""
    j = assignments.join(plan, ["path", "line_number"], "left")
    conflict = F.col("new").isNotNull() & ~F.col("provider").isin(F.col("old"), F.col("new"))
    return j.select("path", "line_number", F.when(conflict, F.col("provider")).otherwise(F.coalesce("old", "provider")).alias("provider"), conflict.alias("conflict"))


def message_key(identity: Column, role: str = "role", text: str = "text", ts: str = "timestamp", kind: str = "source_type", subtype: str = "source_subtype") -> Column:
    """SHA-256 of what a message is, wherever its line moves: `identity`, what refers to it but for positions, as JSON; then
    its role, text, time, type and subtype, each as JSON after a zero byte."""
    fields = [F.concat(F.lit("\u0000"), V.json_or_null(F.col(c).cast("string").cast("variant"))) for c in (role, text, ts, kind, subtype)]
    return F.sha2(F.concat(identity, *fields), 256)


def drop_duplicate_prompts(artifacts: DataFrame, messages: DataFrame, *, session: str, prefix: int = 80, least: int = 16) -> DataFrame:
    """Artifacts that no message of the session repeats: by containing the first `prefix` characters, or, if those are
    fewer than `least`, by being equal. Null texts and sessions repeat nothing and stay."""
    start = F.substring("text", 1, prefix)
    asked = artifacts.select(F.col(session).cast("string").alias("session"), F.when(F.length(start) >= least, start).alias("value"), F.when(F.length(start) < least, F.col("text")).alias("short"))
    said = messages.select(F.col(session).cast("string").alias("session"), F.col("text").alias("value"))
    held = prompts.contained(asked.select("session", "value"), said).select("session", "value", F.lit(True).alias("_long"))
    same = asked.where("short IS NOT NULL").select("session", F.col("short").alias("value")).distinct().join(said, ["session", "value"], "left_semi").withColumn("_long", F.lit(False))
    gone = held.unionByName(same).select(F.col("session").alias("_s"), F.col("value").alias("_v"), "_long")
    long = F.length(start) >= least
    at = (F.col(session).cast("string") == F.col("_s")) & (F.when(long, start).otherwise(F.col("text")) == F.col("_v")) & (long == F.col("_long"))
    return artifacts.join(gone, at, "left_anti")


def redact_entries(docs: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session documents (file_path, record) without the entries that `refs` (file_path, entry_index, fingerprint) name,
    and the references that are stale: no such entry, or its fingerprint is another. Other fields of a document stay.

    Places of one document's entries are gathered, no more than it has entries.
    """
    entries = F.try_variant_get("record", "$.entries", "array<variant>")
    now = docs.select("file_path", F.posexplode(entries).alias("entry_index", "e")).select("file_path", "entry_index", entry_fingerprint(F.col("e")).alias("fingerprint"))
    good = refs.join(now, ["file_path", "entry_index", "fingerprint"], "left_semi")
    stale = refs.join(now, ["file_path", "entry_index", "fingerprint"], "left_anti")
    gone = good.groupBy("file_path").agg(F.collect_set("entry_index").alias("_gone"))
    left = F.filter(entries, lambda e, i: ~F.array_contains("_gone", i))
    return docs.join(gone, "file_path", "left").withColumn("record", F.when(F.col("_gone").isNull(), F.col("record")).otherwise(with_field(F.col("record"), "entries", F.to_variant_object(left)))).drop("_gone"), stale


def redact_entry_rows(entries: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As `redact_entries`, of entries that are rows (file_path, entry_index, entry): those left, and the stale references.
    Nothing is gathered, whatever a session's size."""
    key = ["file_path", "entry_index", "fingerprint"]
    now = entries.withColumn("fingerprint", entry_fingerprint(F.col("entry")))
    return now.join(refs.select(*key).distinct(), key, "left_anti").drop("fingerprint"), refs.join(now.select(*key), key, "left_anti")


def redact_prompts(docs: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session documents (file_path, record) without the prompt that `refs` (file_path, fingerprint) name, and the references that
    are stale: no such document, no prompt in it, or its fingerprint is another. A document's prompt is its field `prompt`, or
    `message` where it has none; a null one is no prompt."""
    fields = F.try_variant_get("record", "$", "map<string,variant>")
    name = F.when(F.map_contains_key(fields, "prompt"), "prompt").otherwise("message")
    value = F.coalesce(*(F.when(name == n, V.at(F.col("record"), f"$.{n}")) for n in ("prompt", "message")))
    now = docs.select("file_path", F.when(~V.is_kind(value, "VOID"), entry_fingerprint(value)).alias("fingerprint"))
    key = ["file_path", "fingerprint"]
    good = refs.select(*key).distinct().join(now, key, "left_semi").select("file_path", F.lit(True).alias("_gone")).distinct()
    left = F.to_variant_object(F.map_filter(fields, lambda k, _: k != name))
    return docs.join(good, "file_path", "left").withColumn("record", F.when(F.col("_gone"), left).otherwise(F.col("record"))).drop("_gone"), refs.join(now, key, "left_anti")


def redact_element_rows(elements: DataFrame, sessions: DataFrame) -> DataFrame:
    """As `redact_array_logs`, of elements that are rows (file_path, line_number, record): those left. An element without a
    session stays."""
    own = V.string_at(F.col("record"), "$.sessionId")
    return elements.withColumn("_id", own).join(sessions.select(F.col("id").alias("_id")).distinct(), "_id", "left_anti").drop("_id")


def entry_fingerprint(v: Column) -> Column:
    """SHA-256 of a JSON value with its keys sorted: the same wherever the value moves."""
    return F.sha2(F.to_json(v), 256)


def with_field(v: Column, key: str, value: Column) -> Column:
    """A JSON object with one field set to a JSON value."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    rest = F.map_filter(fields, lambda k, _: k != key)
    return F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(key), value)))


def _replaced(v: Column, key: str, change: Callable[[Column], Column]) -> Column:
    """A JSON object with the value of a field that it has changed."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    return F.to_variant_object(F.transform_values(fields, lambda k, x: F.when(k == key, change(x)).otherwise(x)))


def redact_artifacts(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Artifact files (session, name, content) but for those named (session, name, fingerprint) whose content is still the same."""
    now = files.withColumn("fingerprint", F.sha2(F.col("content").cast("binary"), 256))
    return now.join(refs.select("session", "name", "fingerprint").distinct(), ["session", "name", "fingerprint"], "left_anti").drop("fingerprint")


def redact_records(records: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (file_path, line_number, record, …) without the lines that `refs` (file_path, line_number, message_index,
    fingerprint) name and without every line of the same file that shares a tool call with one; and the references that
    are stale: no such message, or the line's fingerprint is another. Lines that are no JSON stay.
    """
    at, key = ["file_path", "line_number"], ["file_path", "line_number", "message_index", "fingerprint"]
    prints = records.where("record IS NOT NULL").select(*at, entry_fingerprint(F.col("record")).alias("fingerprint"))
    no_call = F.concat_ws("\u0000", F.lit(""), F.col("line_number").cast("string"), F.col("message_index").cast("string"))
    call = F.coalesce(F.when(F.col("role") == "tool", F.col("tool_call_id")), no_call).alias("call")
    found = normalize.normalize(records).select(*at, "message_index", call).join(prints, at)
    asked = found.join(refs.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    line = F.max("_hit").over(Window.partitionBy(*at))
    marked = asked.withColumn("_hit", line).withColumn("_hit", F.max("_hit").over(Window.partitionBy("file_path", "call")))
    return records.join(marked.where("_hit").select(*at).distinct(), at, "left_anti"), refs.join(found, key, "left_anti")


def redact_array_logs(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Array logs (file_path, record: the whole array) without the elements of the sessions (id), with n_removed; elements
    without a session, and the order of what is left, stay. Of a file only the ids to go are gathered."""
    items = F.try_variant_get("record", "$", "array<variant>")
    own = lambda e: V.string_at(e, "$.sessionId")
    ids = files.select("file_path", F.explode(F.array_distinct(F.transform(items, own))).alias("id"))
    gone = ids.join(sessions.select("id").distinct(), "id", "left_semi").groupBy("file_path").agg(F.collect_set("id").alias("_gone"))
    left = F.filter(items, lambda e: ~F.coalesce(F.array_contains("_gone", own(e)), F.lit(False)))
    some = F.col("_gone").isNotNull()
    removed = F.when(some, F.size(items) - F.size(left)).otherwise(0).cast("long")
    out = files.join(gone, "file_path", "left").withColumn("n_removed", removed)
    return out.withColumn("record", F.when(some, F.to_variant_object(left)).otherwise(F.col("record"))).drop("_gone")


def select_providers(text: str, target: str) -> list[str]:
    """Providers of a comma list, trimmed, sorted, each once; one that is invalid, protected or the target is refused."""
    found = sorted({p.strip() for p in text.split(",") if p.strip()})
    for p in found:
        if not re.fullmatch(r"[A-Za-z0-9_.:-]{1,128}", p) or p in PROTECTED or p == target:
            raise ValueError(f"provider can't be relabelled: {p}")
    return found


def relabel_providers(assignments: DataFrame, threads: DataFrame, sources: list[str], target: str) -> DataFrame:
    """provider, threads, jsonl, valid, candidate, selected: the census that a plan is made from."""
    p = F.col("provider")
    candidate = T.valid_provider(p) & ~p.isin(*PROTECTED, target)
    return provider_census(threads, assignments).select("provider", "threads", "jsonl", T.valid_provider(p).alias("valid"), candidate.alias("candidate"), p.isin(sources).alias("selected"))


def relabel_mappings(assignments: DataFrame, threads: DataFrame, sources: list[str], target: str) -> DataFrame:
    """source, target, threads, jsonl, selected of every provider that may be relabelled or is asked for."""
    p = relabel_providers(assignments, threads, sources, target).where("candidate OR selected")
    return p.select(F.col("provider").alias("source"), F.lit(target).alias("target"), "threads", "jsonl", "selected")


def plan_fingerprint(assignments: DataFrame, threads: DataFrame, sources: list[str], target: str) -> DataFrame:
    """plan_id (one row): a hash of all assignments and threads, whatever their order, the chosen sources and the target."""
    chosen = F.lit(json.dumps([sorted(set(sources)), target]))
    a = set_hash(assignments, "path", "line_number", "provider").withColumnRenamed("set_hash", "_a")
    t = set_hash(threads, "id", "provider").withColumnRenamed("set_hash", "_t")
    return a.crossJoin(F.broadcast(t)).select(F.sha2(F.concat_ws(":", "_a", "_t", chosen), 256).alias("plan_id"))  # one row each


def set_hash(df: DataFrame, *columns: str) -> DataFrame:
    """set_hash (one row): 256 bits that tell which rows there are and how many of each, whatever their order.

    A tree of SHA-256: a row's digest with its count; the sorted digests of all that agree in six hexadecimal digits; of
    those, all that agree in three; of those, all. A node gathers digests alone, at the top 4,096 of them, at the bottom a
    sixteen-millionth of the different rows. Rows are dealt by three digits and sorted, so that a task has a node's rows one
    after another.
    """
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    counted = df.select(row.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    nodes = counted.repartition(F.left("d", F.lit(3))).sortWithinPartitions("d").mapInArrow(_nodes, "h string")
    return nodes.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("set_hash"))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes (h) of three digits, of rows (d, n) that are sorted by d."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = ((d, n) for b in batches for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for _, of_three in itertools.groupby(rows, lambda x: x[0][:3]):
        lower = [sha("".join(sorted(sha(f"{d}:{n}") for d, n in of_six))) for _, of_six in itertools.groupby(of_three, lambda x: x[0][:6])]
        yield pa.RecordBatch.from_pydict({"h": [sha("".join(sorted(lower)))]})


def row_hash(*columns: str) -> Column:
    """48 bits of an MD5, the same in any engine; sums of them don't overflow a decimal."""
    text = F.concat_ws("\u0000", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(20,0)")


def preview_relabel(assignments: DataFrame, threads: DataFrame, sources: list[str], target: str) -> DataFrame:
    """What a plan would do, in one row: candidates, files_scanned, files_to_change, replacements, thread_matches,
    mappings (JSON: source, target, threads and jsonl of each source asked for), blockers and warnings (codes, joined by
    commas), can_apply, has_changes, selection_required, plan_id. Nothing is changed.
    """
    wrong = "active_provider_missing" if not target else "active_provider_invalid" if not re.fullmatch(r"[A-Za-z0-9_.:-]{1,128}", target) else "active_provider_builtin" if target in BUILTIN else ""
    eligible = not wrong
    chosen = sources if eligible else []
    p = relabel_providers(assignments, threads, chosen, target)
    of = p.agg(F.count_if("candidate").alias("candidates"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if("selected").alias("found"))
    hit = F.col("provider").isin(chosen)
    files = assignments.groupBy("path").agg(F.count_if(hit).alias("n"))
    a = files.agg(F.count(F.lit(1)).alias("files_scanned"), F.count_if(F.col("n") > 0).alias("files_to_change"), F.coalesce(F.sum("n"), F.lit(0)).alias("replacements"))
    t = threads.agg(F.count_if(hit).alias("thread_matches"))
    each = F.struct(p["provider"].alias("source"), F.lit(target).alias("target"), "threads", "jsonl")
    m = p.where("selected").agg(F.to_json(F.array_sort(F.collect_list(each))).alias("mappings"))  # no more than are asked for
    t = t.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(threads.limit(1).agg((F.count(F.lit(1)) == 0).alias("_no_threads"))))
    one = of.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(t)).crossJoin(F.broadcast(plan_fingerprint(assignments, threads, chosen, target)))  # one row each
    if not eligible:
        one = one.withColumn("candidates", F.lit(0).cast("long"))
    choose = F.lit(eligible and not chosen) & (F.col("candidates") > 0)
    blockers = F.concat_ws(
        ",", F.when(F.lit(not eligible), wrong), F.when(F.col("invalid") > 0, "invalid_provider_id"),
        F.when(F.col("found") < len(set(chosen)), "source_provider_not_found"), F.when(choose, "source_provider_selection_required"),
    )
    warnings = F.concat_ws(",", F.when(F.lit(eligible), "current_provider_only"), F.when(F.col("_no_threads"), "codex_state_db_missing"))
    return one.select(
        "candidates", "files_scanned", "files_to_change", "replacements", "thread_matches", "mappings", blockers.alias("blockers"), warnings.alias("warnings"), (blockers == "").alias("can_apply"),
        (F.col("replacements") + F.col("thread_matches") > 0).alias("has_changes"), choose.alias("selection_required"), "plan_id",
    )


def plan_holds(plan: DataFrame, assignments: DataFrame, threads: DataFrame, sources: list[str], target: str) -> DataFrame:
    """holds (one row): whether the assignments, threads and choices still give the plan's plan_id (one row)."""
    now = plan_fingerprint(assignments, threads, sources, target).select(F.col("plan_id").alias("_now"))
    return plan.select("plan_id").crossJoin(F.broadcast(now)).select((F.col("plan_id") == F.col("_now")).alias("holds"))  # one row each


def check_plan(plan_id: str, assignments: DataFrame, threads: DataFrame, sources: list[str], target: str) -> None:
    """Refuse a plan that was made from other assignments, threads or choices."""
    if plan_fingerprint(assignments, threads, sources, target).first()[0] != plan_id:
        raise ValueError("stale plan")


def relabel_records(records: DataFrame, plan: DataFrame) -> DataFrame:
    """Records (file_path, line_number, record) with payload.model_provider set on the planned lines, all else as it was.

    A planned line that has neither its old nor its new provider, or isn't there, fails the job.
    """
    now = V.string_at(F.col("record"), "$.payload.model_provider")
    j = _planned(records, plan.select(F.col("path").alias("file_path"), "line_number", "old", "new"), ["file_path", "line_number"], now)
    # a planned line has both fields, or it were stale: their values are replaced where they are
    changed = _replaced(F.col("record"), "payload", lambda payload: _replaced(payload, "model_provider", lambda _: F.col("new").cast("variant")))
    return j.withColumn("record", F.when(F.col("new").isNotNull(), changed).otherwise(F.col("record"))).drop("old", "new")


def plan_threads(threads: DataFrame, sources: list[str], target: str) -> DataFrame:
    """id, old, new of the threads to change: the plan is also the manifest to roll back by."""
    return threads.where(F.col("provider").isin(sources)).select("id", F.col("provider").alias("old"), F.lit(target).alias("new"))


def apply_threads(threads: DataFrame, plan: DataFrame) -> DataFrame:
    """id, provider: each planned thread (id, old, new) gets the new provider. It must be there exactly once with the old one: a
    thread that vanished, changed or came twice since fails the job. The check is a filter, which no later selection prunes."""
    now = threads.groupBy("id", F.col("provider").alias("old")).agg(F.count(F.lit(1)).alias("_n"))
    twice = plan.groupBy("id", "old").agg(F.min("new").alias("new"))
    j = now.join(twice, ["id", "old"], "full")
    stale = F.col("new").isNotNull() & (F.coalesce("_n", F.lit(0)) != 1)
    good = j.where(F.when(stale, F.raise_error(F.lit("threads have changed since the plan"))).cast("boolean").isNull())
    return good.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("id", F.coalesce("new", "old").alias("provider"))


def rollback_threads(threads: DataFrame, plan: DataFrame) -> DataFrame:
    """id, provider, conflict: planned threads (id, old, new) get the old provider back if they have the old or the new one. Others
    have changed since and stay, a conflict; so is a thread that is gone, whose provider is null."""
    j = threads.withColumn("_seen", F.lit(True)).join(plan, "id", "full")
    conflict = F.col("new").isNotNull() & (F.col("_seen").isNull() | ~F.coalesce(F.col("provider").isin(F.col("old"), F.col("new")), F.lit(False)))
    return j.select("id", F.when(conflict, F.col("provider")).otherwise(F.coalesce("old", "provider")).alias("provider"), conflict.alias("conflict"))


def relabel_threads(threads: DataFrame, sources: list[str], target: str) -> DataFrame:
    """id, provider: threads of the sources get the target. An id that is there twice fails the job: an update must hit one row."""
    many = threads.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("provider").alias("provider"))
    new = F.when(F.col("_n") > 1, F.raise_error(F.lit("thread id not unique")).cast("string")).when(F.col("provider").isin(sources), F.lit(target)).otherwise(F.col("provider"))
    return many.select("id", new.alias("provider"))


def check_image(image: DataFrame, backup: DataFrame) -> DataFrame:
    """The before-image (path, line_number, record_sha256, …) with `sound`: whether the backup's record (file_path, line_number,
    record) is still what the image says. Nothing may be rolled back from lines that aren't."""
    kept = backup.select(F.col("file_path").alias("path"), "line_number", F.col("record").alias("_kept"))
    now = entry_fingerprint(F.col("_kept"))
    return image.join(kept.hint("merge"), ["path", "line_number"], "left").withColumn("sound", F.coalesce(now == F.col("record_sha256"), F.lit(False))).drop("_kept")


def restore_records(records: DataFrame, image: DataFrame, backup: DataFrame) -> DataFrame:
    """Records (file_path, line_number, record) with the provider that the before-image (path, line_number, old, new,
    record_sha256) has for its lines. A backup that isn't sound, or a line that is gone or has another provider than the old or
    the new one, fails the job."""
    checked = check_image(image, backup)
    sound = checked.where(F.when(~F.col("sound"), F.raise_error(F.lit("the backup isn't what the plan has saved"))).cast("boolean").isNull())
    return relabel_records(records, sound.select("path", "line_number", F.col("new").alias("old"), F.col("old").alias("new")))


def verify_relabel(assignments: DataFrame, threads: DataFrame, sources: list[str]) -> DataFrame:
    """provider, n of what still has a source's provider: no rows after a complete relabelling."""
    both = assignments.select("provider").unionByName(threads.select("provider"))
    return both.where(F.col("provider").isin(sources)).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
