"""Files that are one JSON array, of any size: read by byte ranges, an element to a row.

Spark's text source cuts a file into ranges at commas. Whether a comma stands between two elements depends on what comes
before it in the file: inside a string or not, and how deep in brackets. Both are sums (of quotes; of opened less closed
brackets), so each range gives one row with its sums, for either case at its start; these rows are added up along the
file, and every piece between two commas then knows its place. Elements are put together from their pieces, mostly one
range's, and parsed one by one. No task holds more than a range or an element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import variants as V

_AT = ["file_path", "block_start"]


def _brackets(clean: Column, inside: Column) -> Column:
    """Opened less closed brackets of a piece (without escapes) that begins inside a string or not."""
    bare = F.regexp_replace(F.concat(F.when(inside == 1, '"').otherwise(""), clean), '"[^"]*("|$)', "")
    return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))


def _before(c: str, w) -> Column:
    return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _pieces(text: DataFrame) -> DataFrame:
    """Pieces (file_path, block_start, value) with `_id` (their place in a range, whichever task has read it), `depth` behind them and `inside` (1: their
    end is in a string)."""
    placed = text.withColumn("_id", F.monotonically_increasing_id()).withColumn("_clean", F.regexp_replace("value", r"(?s)\\.", ""))
    placed = placed.withColumn("_quotes", F.length("_clean") - F.length(F.replace("_clean", F.lit('"'))))
    here, file = Window.partitionBy(*_AT).orderBy("_id"), Window.partitionBy("file_path").orderBy("block_start")
    odd = placed.withColumn("_odd", F.pmod(_before("_quotes", here), F.lit(2)))
    either = odd.withColumns({"_out": _brackets(F.col("_clean"), F.col("_odd")), "_in": _brackets(F.col("_clean"), 1 - F.col("_odd"))}).drop("_clean")
    upto = either.withColumns({"_out": F.sum("_out").over(here), "_in": F.sum("_in").over(here), "_id": F.row_number().over(here)})
    ranges = either.groupBy(*_AT).agg(*(F.sum(c).alias(c) for c in ("_quotes", "_out", "_in"))).withColumn("_began", F.pmod(_before("_quotes", file), F.lit(2)))
    ranges = ranges.withColumn("_all", F.when(F.col("_began") == 0, F.col("_out")).otherwise(F.col("_in"))).select(*_AT, "_began", _before("_all", file).alias("_deep"))
    known = upto.join(ranges, _AT)
    return known.select(
        *text.columns, "_id", (F.col("_deep") + F.when(F.col("_began") == 0, F.col("_out")).otherwise(F.col("_in"))).alias("depth"),
        F.pmod(F.col("_odd") + F.col("_quotes") + F.col("_began"), F.lit(2)).alias("inside"),
    )


def array_elements(text: DataFrame) -> DataFrame:
    """file_path, line_number (the place in the array, from 0), record of every element of files of one array each. text:
    file_path, block_start, value, of a text scan cut at commas with nothing but selections above it.

    A file that holds no array, or one that is broken anywhere, gives no row. What follows the array's end isn't looked at.
    Elements may be of any kind; null elements are rows too.
    """
    pieces = _pieces(text)
    here, file = Window.partitionBy(*_AT).orderBy("_id"), Window.partitionBy("file_path").orderBy("block_start")
    border = (F.col("inside") == 0) & (F.col("depth") == 1)
    marked = pieces.withColumn("_border", border.cast("int")).withColumn("_element", _before("_border", here))
    closed = F.min(F.when((F.col("inside") == 0) & (F.col("depth") <= 0), F.col("_id")))
    ranges = marked.groupBy(*_AT).agg(F.sum("_border").alias("_borders"), closed.alias("_closed"))
    whole = Window.partitionBy("file_path")
    end = F.min(F.when(F.col("_closed").isNotNull(), F.struct("block_start", "_closed"))).over(whole)
    ranges = ranges.select(*_AT, _before("_borders", file).alias("_elements"), end.alias("_end")).where("_end IS NOT NULL")
    placed = marked.join(ranges, _AT).withColumn("_at", F.struct("block_start", F.col("_id").alias("_closed"))).where("_at <= _end")
    number = (F.col("_elements") + F.col("_element")).alias("line_number")
    each = placed.groupBy("file_path", number).agg(F.collect_list(F.struct("_at", "value")).alias("_pieces"), F.max(F.col("_at") == F.col("_end")).alias("_last"))
    joined = F.array_join(F.transform(F.array_sort("_pieces"), lambda x: x["value"]), ",")
    # the first one has the array's opening bracket, the last one its closing one
    one = F.concat(F.when(F.col("line_number") == 0, "").otherwise("["), joined, F.when(F.col("_last"), "").otherwise("]"))
    parsed = each.select("file_path", "line_number", "_last", F.try_variant_get(F.try_parse_json(one), "$", "array<variant>").alias("_array"))
    empty = F.col("_last") & (F.col("line_number") == 0) & (F.size("_array") == 0)
    good = F.col("_array").isNotNull() & (empty | (F.size("_array") == 1))
    broken = parsed.where(~good).select("file_path").distinct()
    return parsed.where(good & ~empty).join(broken, "file_path", "left_anti").select("file_path", "line_number", F.col("_array")[0].alias("record"))


def scan_arrays(spark: SparkSession, paths: list[str], glob: str = "*.json") -> DataFrame:
    """file_path, block_start, value: the pieces between commas of all files below the paths whose name fits the glob."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", ",").text(paths)
    return text.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), "value")


def of_sessions(elements: DataFrame) -> DataFrame:
    """Elements that name a session, with its `id`. One without a sessionId, or whose sessionId is no string, is left out."""
    return elements.withColumn("id", V.string_at(F.col("record"), "$.sessionId")).where("id IS NOT NULL")
