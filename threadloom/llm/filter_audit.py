"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

A document's failed filters are a mask of five bits. Four are properties of its text; the fifth, being identical to the
text of a smaller id anywhere in the table, is found by compressed radix tries that hold whole texts:

1. Each task inserts its texts into a trie whose terminals hold the smallest id, a window of bytes at a time. Of a text
   that stands in a window many times only one row goes on, with its smallest id; the others are duplicates already.
2. What goes on is range-partitioned by adaptive prefixes: a text's range key is its first 8 bytes, or 64 where these are
   heavy, or 512; what is still heavy is cut by a hash of the whole text besides. Equal texts have equal keys, and
   texts that share a long head don't meet in one range.
3. A partition comes sorted by range key and is streamed: a trie for each key, traversed and dropped when the key ends. A
   row is a duplicate if its terminal holds a smaller id.
4. Masks are counted by part and labels, and these counts, 32 masks a part at most, give all 120 orders: what an order's
   step removes depends on the set of filters before it alone, of which there are 16 for each filter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_PARTITIONS, parts, slices, written

FILTERS = "ABCDE"
#: Bytes of distinct texts in a task's trie before it is emptied.
WINDOW_BYTES = 16 << 20
#: The most bytes of texts that one range key has, besides copies from several windows.
MOST_KEY_BYTES = 64 << 20
#: Lengths of range keys.
PREFIXES = (8, 64, 512)
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"#$%&*|"
_SEGMENT = 1 << 20


class Trie:
    """Compressed radix trie over whole texts. A node's edge is a slice of a text that was inserted."""

    def __init__(self) -> None:
        self.edges: list[dict[int, int]] = [{}]
        self.label: list[tuple[bytes, int, int]] = [(b"", 0, 0)]
        self.least: list[int | None] = [None]
        self.size = 0

    def _node(self, text: bytes, start: int, end: int) -> int:
        self.edges.append({})
        self.label.append((text, start, end))
        self.least.append(None)
        return len(self.edges) - 1

    def insert(self, text: bytes, key: int) -> int:
        """The terminal of `text`, which holds the smallest key from now on."""
        at, i, n = 0, 0, len(text)
        while i < n:
            child = self.edges[at].get(text[i])
            if child is None:
                leaf = self._node(text, i, n)
                self.edges[at][text[i]] = leaf
                self.size += n
                at = leaf
                break
            whole, start, end = self.label[child]
            m = common(whole, start, end, text, i)
            if m < end - start:  # the edge is cut in two
                middle = self._node(whole, start, start + m)
                self.edges[at][text[i]] = middle
                self.edges[middle][whole[start + m]] = child
                self.label[child] = (whole, start + m, end)
                child = middle
            at, i = child, i + m
        if self.least[at] is None or key < self.least[at]:
            self.least[at] = key
        return at

    def terminals(self) -> Iterator[tuple[int, bytes]]:
        """Every terminal with its text, by traversal in byte order."""
        todo: list[tuple[int, tuple[bytes, ...]]] = [(0, ())]
        while todo:
            at, path = todo.pop()
            text, start, end = self.label[at]
            path = (*path, text[start:end]) if end > start else path
            if self.least[at] is not None:
                yield at, b"".join(path)
            todo += [(self.edges[at][b], path) for b in sorted(self.edges[at], reverse=True)]


def common(a: bytes, start: int, end: int, b: bytes, i: int) -> int:
    """Length of the common prefix of a[start:end] and b[i:]."""
    n = min(end - start, len(b) - i)
    if a[start : start + n] == b[i : i + n]:
        return n
    at, step = 0, 16
    while a[start + at : start + at + step] == b[i + at : i + at + step]:
        at, step = at + step, 2 * step
    while step > 1:
        step -= step // 2
        if a[start + at : start + at + step] == b[i + at : i + at + step]:
            at += step
    while at < n and a[start + at] == b[i + at]:
        at += 1
    return at


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


_LOCAL = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("text", pa.binary())])


def collapse(batches: Iterator[pa.RecordBatch], window: int = WINDOW_BYTES) -> Iterator[pa.RecordBatch]:
    """Of key and text: a row without text for each duplicate within a window, one with text for the smallest key of each
    distinct text of a window."""

    def ends(trie: Trie, rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        gone = [(k, d, None) for at, k, d in rows if k > trie.least[at]]
        kept = ((trie.least[at], xxhash.xxh3_128_digest(text), text) for at, text in trie.terminals())
        every = itertools.chain(gone, kept)
        while some := list(itertools.islice(every, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _LOCAL, strict=True)], schema=_LOCAL)

    trie, rows = Trie(), []
    for b in slices(batches):
        for key, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
            rows.append((trie.insert(text, key), key, xxhash.xxh3_128_digest(text)))
        if trie.size > window or len(rows) > 200_000:
            yield from ends(trie, rows)
            trie, rows = Trie(), []
    yield from ends(trie, rows)


def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (range_key, key, digest, text) that come sorted by range_key: key and digest of those whose text has a smaller
    key. A trie for each range_key."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.binary())])
    now, trie, rows = None, Trie(), []

    def ends() -> pa.RecordBatch:
        gone = [(k, d) for at, k, d in rows if k > trie.least[at]]
        cols = [*zip(*gone, strict=True)] or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for b in slices(batches):
        for at, key, digest, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != now:
                if len(rows) > 1:
                    yield ends()
                now, trie, rows = at, Trie(), []
            rows.append((trie.insert(text, key), key, digest))
    yield ends()


def duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW_BYTES, most_key_bytes: int = MOST_KEY_BYTES) -> DataFrame:
    """key (as `key`) and digest (128 bits of the text) of every row whose text is that of a smaller key, each once.

    A null text is an empty one. Rows with a null key are neither duplicates nor a reference; rows that repeat a key don't
    count against each other. Other columns aren't read.
    """
    if (kind := dict(docs.dtypes)[key]) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is {kind}; give documents a whole number as their key")
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    local = written(rows.mapInArrow(lambda bs: collapse(bs, window), "key long, digest binary, text binary"), "audit-windows")
    texts = local.where("text IS NOT NULL")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    n = min(MOST_PARTITIONS, parts(total, 16 << 20, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    most = max(1, min(most_key_bytes, total // (4 * n)))
    # heavy prefixes: fewer than total / most a length, so fewer than 4 n or one for each most_key_bytes; 20 bytes each
    hashes = F.array(*(F.struct(F.lit(i).alias("i"), F.xxhash64(F.substring("text", 1, size)).alias("h")) for i, size in enumerate(PREFIXES)))
    heavy = texts.select(F.explode(hashes).alias("x"), F.octet_length("text").alias("n")).groupBy("x.i", "x.h").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("i", "h", F.ceil(F.col("n") / most).cast("int").alias("cuts"))
    heavy = written(heavy, "audit-prefixes")
    for i, size in enumerate(PREFIXES):
        of = heavy.where(F.col("i") == i).select(F.col("h").alias(f"h{i}"), F.col("cuts").alias(f"cuts{i}"))
        texts = texts.withColumn(f"h{i}", F.xxhash64(F.substring("text", 1, size))).join(F.broadcast(of), f"h{i}", "left").drop(f"h{i}")
    last = len(PREFIXES) - 1
    cut = F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64("text"), f"cuts{last}")), 16, "0"))
    ranged = F.concat(F.substring("text", 1, PREFIXES[last]), cut)
    for i, size in reversed([*enumerate(PREFIXES)]):
        ranged = F.when(F.col(f"cuts{i}").isNull(), F.substring("text", 1, size)).otherwise(ranged)
    dealt = texts.select(ranged.alias("range_key"), "key", "digest", "text").repartitionByRange(n, "range_key").sortWithinPartitions("range_key")
    found = dealt.mapInArrow(flag, "key long, digest binary")
    return local.where("text IS NULL").select("key", "digest").unionByName(found).distinct().withColumnRenamed("key", key)


def _distinct(b: bytes) -> tuple[int, int]:
    """Words and distinct words; a long text a segment at a time, so that its words aren't in memory all at once."""
    if len(b) <= _SEGMENT:
        words = b.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(b):
        end = min(len(b), at + _SEGMENT)
        while end < len(b) and not b[end : end + 1].isspace():  # bytes.isspace knows the same six blanks as split
            end += 1
        words = b[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def text_mask(b: bytes, points: int) -> int:
    """Bits of A (under 200 words), B (under half of them distinct), C (over 2 % capitals) and D (any of # $ % & * |)."""
    n, distinct = _distinct(b)
    capitals = len(b) - len(b.translate(None, _UPPER))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | (len(b.translate(None, _MARKS)) < len(b)) << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts, points = _texts(b.column(1)), pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
        mask = pa.array([text_mask(t, n) for t, n in zip(texts, points, strict=True)], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), b.column(2), mask], ["key", "digest", "part", "mask"])


def failures(docs: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per row: key, digest (of the text), part (never null: an empty string instead), mask (bit i: it fails filter i of
    FILTERS). Null texts are empty ones: they fail A alone, and E if a smaller key has one too."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    masks = rows.mapInArrow(_masks, "key long, digest binary, part string, mask int")
    again = duplicates(docs, key=key, text=text).withColumnRenamed(key, "key").withColumn("again", F.lit(16))
    flagged = masks.join(again, ["key", "digest"], "left")
    return flagged.select(F.col("key").alias(key), "digest", "part", (F.col("mask") + F.coalesce("again", F.lit(0))).cast("int").alias("mask"))


def counts(failed: DataFrame, labels: DataFrame | None = None, *, key: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask, how many of them are labelled quality = 1, and toxic = 1.

    `labels`: key, quality, toxic; a key that has several rows is what any of them says. Rows of one key and mask are
    counted together first, so a key of many rows doesn't swell the join.
    """
    slim = failed.groupBy(F.col(key).alias("key"), "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        told = slim.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
        by_key = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
        told = slim.join(by_key, "key", "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return told.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def _steps() -> list[tuple[int, int, int, list[str]]]:
    """For each set of filters before (as bits) and filter: its bit, the number of the step, the orders that have it so."""
    found: dict[tuple[int, int], list[str]] = {}
    for order in itertools.permutations(range(len(FILTERS))):
        for i, f in enumerate(order):
            found.setdefault((sum(1 << x for x in order[:i]), 1 << f), []).append("".join(FILTERS[x] for x in order))
    return [(before, bit, before.bit_count() + 1, orders) for (before, bit), orders in sorted(found.items())]


def interactions(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step, from what `counts` gives: 600 rows a part, zeros included."""
    steps = F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("bit"), F.lit(s).alias("step"), F.array(*map(F.lit, o)).alias("orders")) for b, f, s, o in _steps()))
    x = counted.select("part", "mask", "n", "good", "toxic", F.explode(steps).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    free = F.col("mask").bitwiseAND(F.col("before")) == 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    each = x.groupBy("part", "before", "bit", "step", "orders").agg(
        total("n", free & ~fails).alias("kept"), total("n", free & fails).alias("removed"), total("n", ~free & fails).alias("redundant"), total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", free & fails).alias("good_lost"), total("toxic", free & fails).alias("toxic_lost"),
    )
    shapley = F.sum(F.col("removed") * F.size("orders")).over(Window.partitionBy("part", "bit"))  # 16 rows each
    out = each.withColumn("shapley", shapley).withColumn("filter_order", F.explode("orders"))
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))


def audit(docs: DataFrame, labels: DataFrame | None = None, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What every step of every order of the five filters keeps and removes, by part.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Repeated
    rows count each; rows with a null key are judged by their text, never as duplicates. An empty table has no parts.
    """
    return interactions(counts(failures(docs, key=key, text=text, part=part), labels, key=key))
