"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, shared_dir


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Each node hands its neighbours (large: those above it, small: those below and itself) to its least neighbour. A node
    that many are linked with is dealt over several tasks. `total`: how many edges there are, about."""
    many = F.count(F.lit(1)).alias("n")
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), many)
        return salted_join(near.where("v > u"), least, ["u"], rows="n", total=2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"), many)
    joined = salted_join(edges, least, ["u"], rows="n", total=total)
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, *, most_rounds: int = 50) -> DataFrame:
    """node and component (the smallest node it is linked with, directly or not) of every node that has a link.

    `links`: two integer columns. Null ends, self links and repeats are ignored; an empty table has no nodes. Each round
    is checkpointed, which cuts the lineage, and ends when all links are stars around their least node.
    """
    shared_dir(links.sparkSession)
    a, b = (F.col(c) for c in links.columns)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct().checkpoint()
    before, total = None, edges.count()
    for _ in range(most_rounds):
        edges = _star(_star(edges, True, total), False, total).checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
