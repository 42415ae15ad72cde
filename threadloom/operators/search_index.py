"""Search that reads only the files which can hold a hit: search documents in parts, with a signature beside each.

A part's signature has a bit for each three bytes that stand somewhere in its lower-cased texts. A term can only be in a
part that has the bits of all three bytes in a row of it, so a rare term reads few parts. What is read is searched as
before: signatures decide what isn't read and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import query

#: Bits of a signature, in bitmaps as large as Spark's bitmap functions join.
BITMAP = 1 << 15
BITMAPS = 8
#: There are no more parts than this, so the parts of a query may be broadcast: parts grow beyond it instead.
MOST_PARTS = 100_000


def _bits(text: bytes) -> np.ndarray:
    """The bits of all three bytes in a row of a text."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return three >> np.uint32(32 - (BITMAP * BITMAPS).bit_length() + 1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps (part, n, bits) of a task's rows (part, text); a part that comes in several batches gets several."""
    for b in batches:
        marked: dict[int, np.ndarray] = {}
        for part, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            bits = marked.setdefault(part, np.zeros(BITMAP * BITMAPS, bool))
            if text is not None and len(text) > 2:
                bits[_bits(text)] = True
        maps = [(part, n, np.packbits(x, bitorder="little").tobytes()) for part, bits in marked.items() for n, x in enumerate(bits.reshape(BITMAPS, BITMAP)) if x.any()]
        cols = [*zip(*maps, strict=True)] or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["part", "n", "bits"])


def write_index(documents: DataFrame, path: str, *, key: str = "session_key", text: str = "search_text", parts: int = 1000) -> None:
    """Search documents below `path`, which must not exist yet, in at most `parts` parts dealt by key, and their signatures.
    A null text is in no signature; it holds no term either."""
    n = min(parts, MOST_PARTS)
    dealt = documents.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    dealt.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(f"{path}/documents")
    spark = documents.sparkSession
    dealt.where("false").write.parquet(f"{path}/schema")  # an index without documents has no other file that says it
    lower = spark.read.schema(dealt.schema).parquet(f"{path}/documents").select("part", F.lower(text).alias("text"))
    maps = lower.mapInArrow(_signatures, "part int, n int, bits binary").groupBy("part", "n").agg(F.bitmap_or_agg("bits").alias("bits"))
    maps.write.parquet(f"{path}/signatures")


def matching_parts(signatures: DataFrame, terms: list[str]) -> DataFrame:
    """part of those that have all bits of the terms. A term of fewer than three bytes asks for none; without any bit to ask
    for it's null: every part may match."""
    asked = sorted({int(x) for t in terms if len(t.encode()) > 2 for x in _bits(t.encode())})
    of: dict[int, list[int]] = {}
    for x in asked:
        of.setdefault(x // BITMAP, []).append(x % BITMAP)
    byte = lambda i: F.conv(F.hex(F.substring("bits", i // 8 + 1, 1)), 16, 10).cast("int")
    has = lambda places: reduce(lambda a, b: a & b, (F.getbit(byte(i), F.lit(i % 8)) == 1 for i in places))
    held = [(F.col("n") == n) & has(places) for n, places in of.items()]
    return signatures.where(reduce(lambda a, b: a | b, held)).groupBy("part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(of)).select("part") if held else signatures.select("part").where("false")


def search(spark, path: str, asked: str, *, text: str = "search_text", with_snippet: bool = True) -> DataFrame:
    """`query.search` over an index: the same rows and columns. Parts that can't hold a hit are pruned as partitions, when
    the query runs."""
    documents = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/documents")
    terms = [t for t in T.terms(asked) if len(t.encode()) > 2]
    if terms:
        hits = matching_parts(spark.read.schema("part int, n int, bits binary").parquet(f"{path}/signatures"), terms)
        documents = documents.join(F.broadcast(hits), "part", "left_semi")
    return query.search(documents, asked, text=text, with_snippet=with_snippet).drop("part")
