"""Probing JSON values (VARIANT) by name: a value of another type than asked for counts as missing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def at(v: Column, path: str) -> Column:
    """The value at a path, of any type; null if there is none."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """STRING, BOOLEAN, ARRAY<…>, OBJECT<…>, VOID (JSON null) and so on."""
    return F.schema_of_variant(v)


def is_kind(v: Column, name: str) -> Column:
    return F.coalesce(F.startswith(kind(v), F.lit(name)), F.lit(False))


def string_at(v: Column, path: str) -> Column:
    """The string at a path; null where it is a number or anything else."""
    found = at(v, path)
    return F.when(kind(found) == "STRING", F.try_variant_get(v, path, "string"))


def _own_string(x: Column) -> Column:
    return F.when(kind(x) == "STRING", x.cast("string"))


def strings_at(v: Column, *paths: str) -> Column:
    """The strings at several paths as one array; null where there is none. A select of many `string_at` gives code that is
    too long to be compiled: this is one expression, whose elements are then picked."""
    return F.transform(F.array(*(at(v, p) for p in paths)), _own_string)


def first_string(v: Column, *paths: str) -> Column:
    return F.coalesce(*(string_at(v, p) for p in paths))


def true_at(v: Column, path: str) -> Column:
    return F.coalesce((kind(at(v, path)) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def _text_of(v: object) -> str | None:
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return "\n\n".join(t for t in map(_text_of, v) if t is not None) or None
    if isinstance(v, dict):
        return next((t for t in (_text_of(v[k]) for k in ("text", "thinking", "content", "summary") if k in v) if t is not None), None)
    return None


@F.pandas_udf(ArrayType(StringType()))
def _nested_texts(docs: pd.Series) -> pd.Series:
    return docs.map(lambda ds: None if ds is None else [None if d is None else _text_of(json.loads(d)) for d in ds])


def _plain(v: Column) -> Column:
    return F.coalesce(_own_string(v), _own_string(at(v, "$.text")))


def _flat(v: Column) -> Column:
    """The text of a string, of an object with a plain text, or of an array of these."""
    items = F.try_variant_get(v, "$", "array<variant>")
    joined = F.array_join(F.transform(items, _plain), "\n\n")
    return F.coalesce(_plain(v), F.when(F.forall(items, lambda x: _plain(x).isNotNull()), F.nullif(joined, F.lit(""))))


def _deep(v: Column) -> Column:
    """An object or array that `_flat` can't tell the text of, as JSON."""
    items = F.try_variant_get(v, "$", "array<variant>")
    flat = F.coalesce(F.forall(items, lambda x: _plain(x).isNotNull()), F.lit(False))
    return F.when(_plain(v).isNull() & ~flat & (is_kind(v, "ARRAY") | is_kind(v, "OBJECT")), F.to_json(v))


def extract_texts(contents: Column) -> Column:
    """Text of each of an array of contents: a string; the parts of an array with a blank line between; of an
    object its text, thinking, content or summary, whichever first gives any. Null where there is none.

    Strings, objects with a plain text, and arrays of these stay in built-in functions; only what nests deeper goes, as
    JSON, through one Arrow-batched function.
    """
    deep = F.transform(contents, _deep)
    nested = F.coalesce(_nested_texts(F.when(F.exists(deep, lambda d: d.isNotNull()), deep)), F.array_repeat(F.lit(None).cast("string"), F.size(contents)))
    return F.transform(F.arrays_zip(F.transform(contents, _flat).alias("flat"), nested.alias("nested")), lambda x: F.coalesce(x["flat"], x["nested"]))


def extract_text(v: Column) -> Column:
    """`extract_texts` of one content."""
    return extract_texts(F.array(v))[0]


def json_or_null(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))
