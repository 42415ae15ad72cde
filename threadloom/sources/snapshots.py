"""Snapshots: redacted or relabelled corpora written as a new version, never over what is there, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.ordered import number_lines


def write_snapshot(lines: DataFrame, path: str) -> None:
    """Lines (file_path, line_number, raw) as text below `path`, which must not exist yet: a directory for each file
    (`file_path=…`), whose parts hold its lines in order. Null lines aren't written. A line without a file path, or with a line
    break inside, would not come back as it was: it fails the write.

    Lines are dealt by ranges of file and number: a file of any size is spread over many tasks, and the order of its parts
    is that of their names.
    """
    homeless, broken = F.coalesce(F.col("file_path"), F.lit("")) == "", F.contains("raw", F.lit("\n"))
    sound = F.when(homeless, F.raise_error(F.lit("a line without file_path"))).when(broken, F.raise_error(F.concat(F.lit("a line with a line break inside, of "), "file_path"))).otherwise(F.col("raw"))
    dealt = lines.where("raw IS NOT NULL").repartitionByRange("file_path", "line_number").sortWithinPartitions("file_path", "line_number")
    dealt.select("file_path", sound.alias("value")).write.partitionBy("file_path").option("lineSep", "\n").text(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """file_path, line_number (from 1, in the order of what was written), raw of a snapshot's lines."""
    schema = "value string, file_path string"
    lines = spark.read.schema(schema).option("lineSep", "\n").text(path)
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    placed = lines.select("file_path", F.struct(part.alias("part"), F.col("_metadata.file_block_start").alias("start")).alias("block_start"), F.col("value").alias("raw"))
    return number_lines(placed).drop("block_start")


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents (file_path, record) as JSON below `path`, which must not exist yet: a directory for each file, with one
    line of JSON. An array log keeps its brackets, however few elements are left."""
    docs.select("file_path", F.to_json("record").alias("value")).where("value IS NOT NULL").write.partitionBy("file_path").option("lineSep", "\n").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file_path and record of a snapshot's documents."""
    return spark.read.schema("value string, file_path string").option("lineSep", "\n").text(path).select("file_path", F.try_parse_json("value").alias("record"))


def array_lines(elements: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Lines (file_path, line_number, raw) of array logs from their elements (file_path, line_number, record): the lines of a
    file, one after another, are its array. `files`: file_path of all files; one without elements is an empty array."""
    ends = elements.groupBy("file_path").agg(F.min("line_number").alias("_first"), F.max("line_number").alias("_last"))
    raw = F.concat(F.when(F.col("line_number") == F.col("_first"), "[").otherwise(","), F.coalesce(F.to_json("record"), F.lit("null")), F.when(F.col("line_number") == F.col("_last"), "]").otherwise(""))
    lines = elements.join(ends, "file_path").select("file_path", "line_number", raw.alias("raw"))
    if files is None:
        return lines
    bare = files.select("file_path").distinct().join(ends, "file_path", "left_anti")
    return lines.unionByName(bare.select("file_path", F.lit(0).cast("long").alias("line_number"), F.lit("[]").alias("raw")))


def write_array_logs(elements: DataFrame, path: str, files: DataFrame | None = None) -> None:
    """Array logs as a new version: a directory for each file, whose parts make up its array. An array of any size is spread
    over many tasks; see `array_lines`."""
    write_snapshot(array_lines(elements, files), path)


def read_array_logs(spark: SparkSession, path: str) -> DataFrame:
    """file_path, line_number (the place in the array, from 0), record of the elements of a version of array logs."""
    lines = read_snapshot(spark, path)
    # a parser that has read the array's end doesn't look at the bracket that the last line has besides
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.substring("raw", 2, 1 << 30), F.lit("]"))), "$", "array<variant>")
    return lines.withColumn("_e", one).where(F.size("_e") > 0).select("file_path", F.col("line_number") - 1, F.col("_e")[0].alias("record")).toDF("file_path", "line_number", "record")
