"""Best-fit packing under conflicts.

Documents are cut into pieces of at most `capacity` tokens and put into bins of that capacity. A bin never holds two
pieces of one duplicate cluster, nor more than `max_per_source` of one source. Bins are ordered by what is left in
them; each piece, largest first, goes to the tightest bin that has room and no conflict: the search starts at the
smallest sufficient remainder and moves to the successor while bitmaps of the bin's sources and clusters conflict. A full
bin is closed, to pieces of nothing as well.

Documents are dealt by hash into shards of about `shard_docs`, each packed by one task. Only keys, lengths, sources and
cluster hashes travel. A cluster or source that holds a third of the rows is spread over all shards. Rows that are equal
in all of these are told apart by a number, so they are spread too, and bins don't depend on how the input is laid out.

By itself `pack` knows copies equal but for case; `with_clusters` finds near copies first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard_join
from .common import parts, salted_join, word_count, written
from .components import components

#: Equal rows that one task counts out at a time.
RUN = 4096


def best_fit(sizes: Iterable[int], sources: Iterable[int], clusters: Iterable[int], capacity: int, max_per_source: int) -> list[int]:
    """The bin of each piece. Pieces are placed by size, largest first, ties by position."""
    sizes, sources, clusters = list(sizes), list(sources), list(clusters)
    shared = {c: i for i, c in enumerate(c for c, n in Counter(clusters).items() if n > 1)}
    source_bit: dict[int, int] = {}
    order: list[int] = []  # remainder and bin in one integer, ascending
    seen_clusters: list[int] = []
    seen_sources: list[list[int]] = []  # bitmap j: sources that have more than j pieces in the bin
    at = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[k]
        cluster = 1 << shared[clusters[k]] if clusters[k] in shared else 0
        source = 1 << source_bit.setdefault(sources[k], len(source_bit))
        i = bisect_left(order, size << 32)
        while i < len(order) and (seen_clusters[b := order[i] & 0xFFFFFFFF] & cluster or seen_sources[b][-1] & source):
            i += 1
        if i < len(order):
            left, b = order[i] >> 32, order.pop(i) & 0xFFFFFFFF
        else:
            left, b = capacity, len(seen_clusters)
            seen_clusters.append(0)
            seen_sources.append([0] * max_per_source)
        at[k] = b
        seen_clusters[b] |= cluster
        level = next(j for j, m in enumerate(seen_sources[b]) if not m & source)
        seen_sources[b][level] |= source
        if left > size:
            insort(order, (left - size) << 32 | b)
    return at


def pack_shard(t: pa.Table, capacity: int, max_per_source: int) -> pa.Table:
    """Pieces and bins of one shard, whose rows are put in order first: what comes out doesn't depend on arrival."""
    t = t.sort_by([("tokens", "descending"), ("key", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
    n = t.column("tokens").to_numpy()
    count = np.maximum(1, -(-n // capacity))
    row = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(row)) - np.repeat(count.cumsum() - count, count)
    first = piece * capacity
    size = np.minimum(capacity, n[row] - first)
    bins = best_fit(size.tolist(), t.column("source").to_numpy()[row].tolist(), t.column("cluster").to_numpy()[row].tolist(), capacity, max_per_source)
    b = np.array(bins, np.int64)
    by_bin = np.lexsort((first, row, b))
    slot = np.empty(len(b), np.int64)
    starts = np.flatnonzero(np.diff(b[by_bin], prepend=-1))
    slot[by_bin] = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    shard = t.column("shard").to_numpy()[row]
    return pa.table({"key": t.column("key").take(pa.array(row)), "piece": piece, "first_token": first, "n_tokens": size, "bin_id": (shard << 32) | b, "slot": slot})


def exact_hash(text: str) -> Column:
    return F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))


def with_clusters(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: key, source, tokens (words) and cluster, for `pack`: rows share a cluster whose documents are in one class
    of the Jaccard join, or whose texts are equal but for case, directly or not. Rows without words or without a key
    are in no class; by equal texts they are in a cluster too."""
    kind = dict(docs.dtypes)[key]
    hashed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"), exact_hash(text).alias("exact"))
    classed = jaccard_join.class_rows(hashed, key="key", carry=("source", "exact"))
    rows = written(classed.select("key", "source", "exact", F.col("n_words").alias("tokens"), F.when(F.col("key").isNotNull() & (F.col("n_words") > 0), F.col("component_id")).alias("c")), "packing-rows")
    known, keyless = rows.where("c IS NOT NULL"), rows.where("key IS NULL")

    def meet(by: str) -> DataFrame:
        """Classes that meet in one text or key, each with the least of them. Nearly all texts and keys have one class alone;
        the rest are written first, so that few of them are broadcast."""
        several = written(known.groupBy(by).agg(F.min("c").alias("least"), F.max("c").alias("_most")).where("least < _most").select(by, "least"), "packing-several")
        return known.join(several, by).where("c <> least").select("c", "least").distinct()

    roots = written(components(meet("exact").unionByName(meet("key"))).toDF("c", "root"), "packing-roots")
    moved = written(known.join(roots, "c").groupBy("c", "root").agg(F.count(F.lit(1)).alias("n")), "packing-moved")
    found = salted_join(known, moved, ["c"], rows="n", total=rows.count(), how="left").withColumn("c", F.coalesce("root", "c")).drop("root").unionByName(rows.where("key IS NOT NULL AND c IS NULL"))
    if not keyless.isEmpty():
        least = known.groupBy("exact").agg(F.min("c").alias("c")).join(roots, "c", "left").select("exact", F.coalesce("root", "c").alias("c"))
        found = found.unionByName(keyless.drop("c").join(least, "exact", "left").select(*found.columns))
    cluster = F.coalesce(F.when(F.col("c").isNotNull(), F.xxhash64("c", F.lit("class"))), F.col("exact"))
    return found.select(F.col("key").cast(kind).alias(key), F.col("source").alias(source), "tokens", cluster.alias("cluster"))


def pack(docs: DataFrame, *, capacity: int = 2048, max_per_source: int = 2, shard_docs: int = 4096, key: str = "doc_id", text: str = "text", source: str = "source", tokens: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """Per piece: key, piece, first_token, n_tokens, bin_id, slot (its place in the bin).

    `tokens` defaults to the words of the text and `cluster` to a hash of the lower-cased text (a collision of hashes
    can only keep two documents apart). Every row is packed: one without tokens is a piece of 0; a null source is a
    source of its own; rows that repeat a key are packed one by one; other columns aren't read. An empty table has no bins.
    """
    if capacity < 1 or max_per_source < 1:
        raise ValueError("capacity and max_per_source must be positive")
    tokens = word_count(F.col(text)) if tokens is None else tokens
    cluster = exact_hash(text) if cluster is None else cluster
    kind = dict(docs.dtypes)[key]
    own = ["key", "tokens", "source", "cluster"]
    slim = docs.select(F.col(key).alias("key"), tokens.cast("long").alias("tokens"), F.xxhash64(source).alias("source"), cluster.cast("long").alias("cluster"))
    counted = written(slim.groupBy(*own).agg(F.count(F.lit(1)).alias("n")), "packing")
    shards = parts(counted.agg(F.sum("n")).first()[0] or 0, shard_docs, 1)
    # numbers of equal rows, in runs that are dealt before they are counted out
    runs = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    spread = runs.where("n <= 1").unionByName(runs.where("n > 1").repartition(F.xxhash64(*own, "first")))
    rows = spread.withColumn("number", F.explode(F.sequence("first", F.least(F.col("first") + RUN, F.col("n")) - 1)))
    dealt = rows.select(*own, F.pmod(F.xxhash64(*own, "number"), F.lit(shards)).alias("shard"))
    out = dealt.groupBy("shard").applyInArrow(lambda t: pack_shard(t, capacity, max_per_source), f"key {kind}, piece long, first_token long, n_tokens long, bin_id long, slot long")
    return out.withColumnRenamed("key", key)
