"""Helpers shared by the operators: shared folders, written tables, text measures in SQL, packed arrays."""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.shared import new_path, shared_dir  # noqa: F401 - used by the operators

#: A word: a run of characters other than space and \t \n \v \f \r. `bytes.split()` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
BLANK_BYTES = b" \t\n\x0b\x0c\r"

def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lost executors don't make Spark recompute what came before. It stays until
    `shared.forget`, as results may still read it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about `most` bytes. Spark bounds a batch by rows and bytes; what Python makes of it is
    bounded by the slice, however long texts are. The session's settings stay as they are."""
    for b in batches:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of all texts; sizes groups, so that they grow in number and not in size."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return row[0], row[1] or 0


def parts(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


#: Bytes of text in a group of documents, which a task holds whole.
GROUP_BYTES = 4 << 20


def group_count(docs: DataFrame, text: str) -> int:
    """Groups for `grouped`: as many as the texts' bytes ask for, and enough for a small table to use a few dozen cores."""
    _, size = text_bytes(docs, text)
    return parts(size, GROUP_BYTES, min(48, 2 * docs.sparkSession.sparkContext.defaultParallelism))


def pack(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def squeeze(b: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b)


def unsqueeze(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_ODD = [np.uint64(2 * k + 1) for k in np.random.default_rng(5).integers(1 << 40, 1 << 62, 16)]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, from the words' hashes."""
    n = len(h) - k + 1
    out = h[:n] * _ODD[0]
    for j in range(1, k):
        out = out + h[j : n + j] * _ODD[j]
    return mixed(out)


#: Bytes hashed at a time, and the most that a word may have to be hashed among others.
SEGMENT = 1 << 18
#: Bytes of a word that are read as numbers; a longer word is hashed by itself.
WHOLE = 24
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANK_BYTES)] = True
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words_at(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of b on as a number, but for the last seven places."""
    n = max(0, len(b) - 7)
    out = np.empty(n, np.uint64)
    for i in range(min(8, n)):
        out[i::8] = np.frombuffer(b, "<u8", len(range(i, n, 8)), i)
    return out


def stirred(h: np.ndarray) -> np.ndarray:
    """Every bit of 64-bit values over all bits; no two values become one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _segment(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, lengths and places of the words of at most SEGMENT bytes. A word of up to WHOLE bytes goes in whole, 8 bytes at
    a time, stirred in between; no sums or products of its bytes can cancel each other out."""
    edge = np.diff(np.concatenate([[True], _IS_BLANK[b], [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    length = end - start
    read = words_at(np.concatenate([b, np.zeros(WHOLE, np.uint8)]))
    h = length.astype(np.uint64)
    for at in range(0, WHOLE, 8):
        some = slice(None) if at == 0 else np.flatnonzero(length > at)
        h[some] = stirred(h[some] + (read[start[some] + at] & _FIRST_BYTES[np.minimum(length[some] - at, 8)]))
    for i in np.flatnonzero(length > WHOLE).tolist():
        h[i] = xxhash.xxh3_64_intdigest(b[start[i] : end[i]])
    return h, length, start


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash and length of each word of all texts, one after another, and how many words each text has."""
    joined = b"\n".join(texts)
    b = np.frombuffer(joined, np.uint8)
    found, at = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)], 0
    while at < len(b):
        end = min(at + SEGMENT, len(b))
        if end < len(b) and not _IS_BLANK[b[end]]:  # back to the last blank, or on to the end of a very long word
            blank = np.flatnonzero(_IS_BLANK[b[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:
                end = min((i for c in BLANK_BYTES if (i := joined.find(c, end)) >= 0), default=len(b))
        if end - at > SEGMENT:
            found.append((np.array([xxhash.xxh3_64_intdigest(joined[at:end])], np.uint64), np.array([end - at]), np.array([at])))
        else:
            hashes, lengths, start = _segment(b[at:end])
            found.append((hashes, lengths, start + at))
        at = end
    hashes, lengths, start = map(np.concatenate, zip(*found, strict=True))
    upto = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
    return hashes, lengths, np.diff(upto, prepend=0)


MOST_PARTITIONS = 20_000


def dealt(df: DataFrame, by: str, n: int) -> DataFrame:
    """df with values 0 to n - 1 of `by` dealt over as many partitions (p), one for each, up to MOST_PARTITIONS: the
    number of tasks grows with the input and no two values meet in one by chance. Group by p and `by`."""
    p = min(n, MOST_PARTITIONS)
    return df.withColumn("p", F.pmod(by, F.lit(p)).cast("int")).repartitionById(p, F.col("p"))


#: A key with more than this share of all rows is dealt over several tasks; fewer keys than this have so many.
HOT_SHARES = 512
#: No key of a table of slim rows is too much for a task up to here.
SALTED_FROM = 5_000_000


def salted_join(left: DataFrame, right: DataFrame, on: list[str], *, rows: str, total: int, how: str = "inner", shares: int = HOT_SHARES, least: int | None = None) -> DataFrame:
    """left joined with right, which has each key of `on` once and tells in the column `rows` how many rows of left have
    it, of `total` in all. A key that more than total / shares rows have is dealt over as many salts as bring it below
    that; there are fewer than `shares` such keys, so they are broadcast. `rows` isn't in the result.

    Catalyst splits skewed keys only where both sides come straight from their shuffles; here right is an aggregate. Up to
    `least` rows (SALTED_FROM) in all it's a plain join, with a smaller plan and the same result.
    """
    if total <= (SALTED_FROM if least is None else least):
        return left.join(right.drop(rows), on, how)
    share = max(1, total // shares)
    salts = F.ceil(F.col(rows) / share).cast("int")
    hot = right.where(F.col(rows) > share).select(*on, salts.alias("_salts"))
    dealt_left = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*left.columns), "_salts").cast("int"), F.lit(0))).drop("_salts")
    dealt_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(rows)
    return dealt_left.join(dealt_right, [*on, "_salt"], how).drop("_salt")


def grouped(docs: DataFrame, groups: int, key: str, text: str, *carry: str) -> DataFrame:
    """g, p, key (long), text and carried columns: rows dealt into groups of about equal size by key and text. A key of
    another type than a whole number is an error that names it."""
    if (kind := dict(docs.dtypes)[key]) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is {kind}; give documents a whole number as their key")
    rows = docs.select(F.pmod(F.xxhash64(key, text), F.lit(groups)).alias("g"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    return dealt(rows, "g", groups)
