"""Readers: line-delimited JSON, one document per session, arrays shared by sessions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import variants as V
from threadloom.operators.normalize import is_context
from threadloom.operators.ordered import contiguous_prefix, number_lines
from threadloom.sources import arrays

#: What the first event of every session document says.
INFO = "Legacy Claude Code metadata; full project transcript is unavailable."


#: How far below its root a file may be: in the root itself is 1.
DEPTH = 16


def _near(spark: SparkSession, roots: list[str], depth: int = DEPTH) -> Column:
    """Whether file_path is at most so many levels below a root, or is one itself. Where a root is a pattern, every file is."""
    if any(re.search(r"[*?\[{]", r) for r in roots):
        return F.lit(True)
    plain = [re.escape(spark._jvm.org.apache.hadoop.fs.Path(r).toUri().getRawPath().rstrip("/")) for r in roots]
    return F.col("file_path").rlike(f"^([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)?({'|'.join(plain)})(/[^/]+){{0,{depth}}}$")


def present_sources(spark: SparkSession, sources: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """kind and display name of the sources (root, kind, display name) whose root is there, the first of each kind."""
    found: dict[str, str] = {}
    for root, kind, name in sources:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if kind not in found and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found[kind] = name
    return [*found.items()]


def read_jsonl(spark: SparkSession, roots: list[str], kind: str, *, archived: bool = False, glob: str = "*.jsonl") -> DataFrame:
    """Every line of the files below the roots whose name fits the glob, numbered in its file; blank lines count but give no row. `record` is null
    where a line is no JSON: `parse_errors` finds those. Files more than DEPTH levels below their root aren't read."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(roots)
    raw = lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("file_mtime"), F.regexp_replace("value", "\r$", "").alias("raw")).where(_near(spark, roots))
    numbered = number_lines(raw).drop("block_start").where(F.trim("raw") != "")
    return numbered.withColumn("record", F.try_parse_json("raw")).withColumn("source_kind", F.lit(kind)).withColumn("archived", F.lit(archived))


def read_documents(spark: SparkSession, roots: list[str], kind: str) -> DataFrame:
    """One JSON document per file; files without sessionId or id are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(roots, wholetext=True)
    out = files.select(F.col("_metadata.file_path").alias("file_path"), F.try_parse_json("value").alias("record"))
    text = lambda path: V.string_at(F.col("record"), path)
    stamp = lambda path: F.coalesce(text(path), F.when(V.is_kind(V.at(F.col("record"), path), "BIGINT"), F.try_variant_get("record", path, "string")))
    time = T.epoch_or_text(F.coalesce(stamp("$.startedAt"), stamp("$.createdAt"), stamp("$.timestamp")))
    return out.withColumn("id", F.coalesce(text("$.sessionId"), text("$.id"))).where("id IS NOT NULL").withColumn("timestamp", time).withColumn("cwd", F.coalesce(text("$.projectPath"), text("$.cwd"))).withColumn("source_kind", F.lit(kind))


def read_array_logs(spark: SparkSession, roots: list[str]) -> DataFrame:
    """file_path, line_number (the place, from 0), record, id of the elements of every logs.json below `<root>/tmp`, at most
    three levels deep, that name a session. Files are read by ranges, so they may be of any size."""
    tmp = [spark._jvm.org.apache.hadoop.fs.Path(f"{r.rstrip('/')}/tmp").toUri().getRawPath() for r in roots]
    depth = f"({'|'.join(map(re.escape, tmp))})/([^/]+/){{0,2}}logs\\.json$"
    text = arrays.scan_arrays(spark, [f"{r.rstrip('/')}/tmp" for r in roots], "logs.json").where(F.col("file_path").rlike(depth))
    return arrays.of_sessions(arrays.array_elements(text))


def array_log_elements(files: DataFrame) -> DataFrame:
    """file_path, line_number, record, id of the elements of array logs (file_path, record) that name a session."""
    whole = files.where(V.is_kind(F.col("record"), "ARRAY")).select("file_path", F.col("record").alias("_array"))
    each = whole.lateralJoin(files.sparkSession.tvf.variant_explode(F.col("_array").outer()))
    return arrays.of_sessions(each.select("file_path", F.col("pos").cast("long").alias("line_number"), F.col("value").alias("record")))


def parse_errors(records: DataFrame) -> DataFrame:
    return records.where("record IS NULL")


def file_manifest(files: DataFrame) -> DataFrame:
    return files.select("file_path", "file_size", "file_mtime").distinct()


def read_manifest(spark: SparkSession, roots: list[str], glob: str = "*", *, hashes: bool = False) -> DataFrame:
    """file_path, file_size, file_mtime and sha256 of every file below the roots whose name fits the glob. Contents are read
    for the hashes alone, which are null unless asked for. Empty files have no row: Spark's scans leave them out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
    sha = F.sha2("content", 256) if hashes else F.lit(None).cast("string")
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_mtime"), sha.alias("sha256"))


def choose_root(spark: SparkSession, root: str) -> str:
    """`projects` below a root if that is a directory, else `sessions`."""
    projects = f"{root.rstrip('/')}/projects"
    path = spark._jvm.org.apache.hadoop.fs.Path(projects)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return projects if found.exists(path) and found.getFileStatus(path).isDirectory() else f"{root.rstrip('/')}/sessions"


def read_history(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_path, line_number, id, timestamp, display, project, pasted_contents (JSON), parse_error of every line of the
    prompt history; a line that is no JSON, a blank one too, has nothing but its raw text and parse_error."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    raw = lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), F.regexp_replace("value", "\r$", "").alias("raw"))
    r = F.try_parse_json("raw")
    return history_rows(number_lines(raw).drop("block_start").withColumn("record", r))


def history_rows(lines: DataFrame) -> DataFrame:
    """Prompt-history rows of numbered lines (file_path, line_number, raw, record)."""
    r = F.col("record")
    millis = F.when(V.is_kind(V.at(r, "$.timestamp"), "BIGINT") | V.is_kind(V.at(r, "$.timestamp"), "DECIMAL"), F.try_variant_get(r, "$.timestamp", "string"))
    stamp = T.epoch_or_text(F.coalesce(V.string_at(r, "$.timestamp"), millis))
    id_ = F.when(V.at(r, "$.sessionId").isNotNull(), V.string_at(r, "$.sessionId")).otherwise(V.string_at(r, "$.session_id"))
    return lines.select(
        "file_path", "line_number", "raw", id_.alias("id"), stamp.alias("timestamp"), V.string_at(r, "$.display").alias("display"),
        V.string_at(r, "$.project").alias("project"), F.coalesce(F.to_json(V.at(r, "$.pastedContents")), F.lit("{}")).alias("pasted_contents"), r.isNull().alias("parse_error"),
    )


def document_records(docs: DataFrame) -> DataFrame:
    """file_path, line_number (the place, from 0), record of the entries of session documents; of a document without
    entries its prompt or message is the one entry, a user's."""
    entries = F.try_variant_get("record", "$.entries", "array<variant>")
    has = V.is_kind(V.at(F.col("record"), "$.entries"), "ARRAY")
    many = docs.where(has).select("file_path", "id", F.posexplode(entries).alias("line_number", "record"))
    prompt = V.first_string(F.col("record"), "$.prompt", "$.message")
    made = F.parse_json(F.to_json(F.struct(F.lit("legacy").alias("type"), F.col("timestamp"), F.struct(F.lit("user").alias("role"), prompt.alias("content")).alias("message"))))
    one = docs.where(~has & prompt.isNotNull()).select("file_path", "id", F.lit(0).alias("line_number"), made.alias("record"))
    return many.unionByName(one).withColumn("line_number", F.col("line_number").cast("long"))


def _prompt(record: Column) -> Column:
    """The prompt or message of a document without entries."""
    return F.when(~V.is_kind(V.at(record, "$.entries"), "ARRAY"), V.first_string(record, "$.prompt", "$.message"))


def _of_root(docs: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with `_root`, the directory that holds the history, and the directory of the documents beside it."""
    return docs.withColumn("_root", F.regexp_replace("file_path", r"/[^/]+/[^/]+$", "")), history.withColumn("_root", F.regexp_replace("file_path", r"/[^/]+$", ""))


def document_events(docs: DataFrame, history: DataFrame) -> DataFrame:
    """file_path, id, line_number, timestamp, type, payload (JSON) of the events of session documents: one that tells what
    they are, the prompt of a document without entries, and the lines of the history beside them that have their id.

    A history line that is no JSON is an event of every session of its root. It is given once, with its own file_path and
    a null id: a row for each session and line would grow with their product.
    """
    docs, history = _of_root(docs, history)
    ts, prompt = T.blank_to_null(F.col("timestamp")).alias("timestamp"), _prompt(F.col("record"))
    head = ["file_path", "id"]
    message = lambda c: F.to_json(F.struct(c.alias("message")))
    info = docs.select(*head, F.lit(None).cast("long").alias("line_number"), ts, F.lit("info").alias("type"), message(F.lit(INFO)).alias("payload"))
    asked = docs.where(prompt.isNotNull()).select(*head, F.lit(1).cast("long").alias("line_number"), ts, F.lit("user").alias("type"), message(prompt).alias("payload"))
    said = F.to_json(F.struct("display", "project", F.parse_json("pasted_contents").alias("pasted_contents")), {"ignoreNullFields": "false"})
    lines = history.where("NOT parse_error").select("_root", "id", "line_number", ts, F.lit("user_input").alias("type"), said.alias("payload"))
    own = docs.select(*head, "_root").join(lines, ["_root", "id"]).drop("_root")
    bad = history.where("parse_error").select("file_path", F.lit(None).cast("string").alias("id"), "line_number", F.lit(None).cast("string").alias("timestamp"), F.lit("parse_error").alias("type"), F.to_json(F.struct(F.col("raw").alias("raw_line"))).alias("payload"))
    return info.unionByName(asked).unionByName(own).unionByName(bad)


def document_event_counts(docs: DataFrame, history: DataFrame) -> DataFrame:
    """file_path, id, event_count: the document's own events, its history lines, and the root's lines that are no JSON.
    The history is reduced to a row per session, and to one per root, before it is joined."""
    docs, history = _of_root(docs, history)
    lines = history.where("NOT parse_error AND id IS NOT NULL").groupBy("_root", "id").agg(F.count(F.lit(1)).alias("_lines"))
    bad = history.where("parse_error").groupBy("_root").agg(F.count(F.lit(1)).alias("_bad"))
    own = F.when(_prompt(F.col("record")).isNotNull(), 2).otherwise(1)
    slim = docs.select("file_path", "id", "_root", own.cast("long").alias("_own")).join(lines, ["_root", "id"], "left").join(bad, "_root", "left")
    return slim.select("file_path", "id", (F.col("_own") + F.coalesce("_lines", F.lit(0)) + F.coalesce("_bad", F.lit(0))).alias("event_count"))


def history_messages(docs: DataFrame, history: DataFrame) -> DataFrame:
    """file_path, id, line_number, role, text, timestamp, source_type, source_subtype, synthetic_context: the user's
    messages that history lines with a display add to session documents."""
    docs, history = _of_root(docs, history)
    text = T.strip(F.col("display"))
    lines = history.where("display IS NOT NULL").select(
        "_root", "id", "line_number", F.lit("user").alias("role"), text.alias("text"), T.blank_to_null(F.col("timestamp")).alias("timestamp"),
        F.lit("user_input").alias("source_type"), F.lit("display").alias("source_subtype"), is_context(F.lit("user"), text).alias("synthetic_context"),
    )
    return docs.select("file_path", "id", "_root").join(lines, ["_root", "id"]).drop("_root")


def read_artifacts(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Messages of the artifact files of `<root>/antigravity/brain/<session>/`: see `artifact_messages`."""
    dirs = [f"{r.rstrip('/')}/antigravity/brain/*/*" for r in roots]
    files = spark.read.format("binaryFile").load(dirs)
    parts = F.split("path", "/")
    return artifact_messages(files.select(F.element_at(parts, -2).alias("session"), F.element_at(parts, -1).alias("name"), T.lossy_text(F.col("content")).alias("content")))


def attach_sidecar(files: DataFrame) -> DataFrame:
    """Files (session, name, content) with the time that `<name>.metadata.json` beside them says; '' without one."""
    ending = ".metadata.json"
    meta = F.try_parse_json("content")
    stamp = F.coalesce(V.string_at(meta, "$.updatedAt"), F.when(V.is_kind(V.at(meta, "$.updatedAt"), "BIGINT"), F.try_variant_get(meta, "$.updatedAt", "string")))
    side = files.where(F.endswith("name", F.lit(ending))).select("session", F.expr(f"left(name, length(name) - {len(ending)})").alias("name"), T.epoch_or_text(stamp).alias("timestamp"))
    return files.join(side, ["session", "name"], "left").withColumn("timestamp", F.coalesce("timestamp", F.lit("")))


def artifact_messages(files: DataFrame, *, fragments_are_prompts: bool = False, max_chars: int = 20_000) -> DataFrame:
    """session, name, part, role, text, timestamp from files (session, name, content).

    A file is a user's message (part -1) unless its name marks it as metadata, an answer or an upload. Answers of
    `name` are `name.resolved` (part 0) and `name.resolved.0`, `.1`, … (parts 1, 2, …) up to the first gap. Blank files
    give no row; a file is a prompt as well if `fragments_are_prompts`, even where it is a fragment of an answer.
    """
    text = T.strip(F.left("content", F.lit(max_chars)))
    sound = files.where(T.valid_session_id(F.col("session")))
    fragment = F.regexp_extract("name", r"^(.*)\.resolved\.(\d+)$", 2)
    prompt = ~F.endswith("name", F.lit(".metadata.json")) & ~F.endswith("name", F.lit(".resolved")) & ~F.startswith(F.lower("name"), F.lit("uploaded_"))
    asks = attach_sidecar(sound).where(prompt if fragments_are_prompts else prompt & (fragment == ""))
    asked = asks.select("session", "name", F.lit(-1).cast("long").alias("part"), F.lit("user").alias("role"), text.alias("text"), "timestamp")
    base = F.regexp_extract("name", r"^(.*)\.resolved(\.\d+)?$", 1)
    answers = sound.where(F.endswith("name", F.lit(".resolved")) | (fragment != "")).select("session", base.alias("name"), F.when(fragment != "", fragment.try_cast("long")).alias("idx"), text.alias("text"))
    whole = answers.where("idx IS NULL").withColumn("part", F.lit(0).cast("long"))
    run = contiguous_prefix(answers.where("idx IS NOT NULL").withColumn("_file", F.struct("session", "name")), "_file", "idx").withColumn("part", F.col("idx") + 1)
    given = whole.select("session", "name", "part", "text").unionByName(run.select("session", "name", "part", "text")).join(asks.select("session", "name").distinct(), ["session", "name"], "left_semi")
    out = asked.unionByName(given.select("session", "name", "part", F.lit("assistant").alias("role"), "text", F.lit("").alias("timestamp")))
    return out.where(F.col("text") != "")


def read_threads(df: DataFrame) -> DataFrame:
    """id, provider of a thread table, a null provider as ''; a table without these columns is refused."""
    lacking = {"id", "model_provider"} - set(df.columns)
    if lacking:
        raise ValueError(f"thread table without {', '.join(sorted(lacking))}")
    return df.select("id", F.coalesce("model_provider", F.lit("")).alias("provider"))


def scan_assignments(records: DataFrame) -> DataFrame:
    """path, line_number, session_id, provider of the session_meta lines that name a provider.

    The provider goes through an `explode`, below which no filter is pushed: there it would parse a line, or make its record,
    anew for each mention.
    """
    r = F.col("record")
    provider = F.when(F.try_variant_get(r, "$.type", "string") == "session_meta", V.string_at(r, "$.payload.model_provider"))
    found = records.select(F.col("file_path").alias("path"), "line_number", r, F.explode(F.array(provider)).alias("provider")).where("provider IS NOT NULL")
    return found.select("path", "line_number", V.string_at(r, "$.payload.id").alias("session_id"), "provider")
