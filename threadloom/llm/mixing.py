"""Mixing sources to target weights by temperature.

A source's share of all tokens, raised to an exponent, is its weight. The exponent, a multiple of 10^-6 from 0 to 1, is
bisected to meet a target: either the weights' entropy, or how often a document of the most repeated source may occur.
The budget defaults to the smallest that uses every document at least once, so a mixture drops nothing.

A source's budget is spent in passes over its documents, each a permutation given by a hash of pass, key and text. Whole
passes take all. In the last one, permutation blocks are taken whole up to the block in which the budget ends; only
inside that block are rows counted one by one. Blocks are as many as the root of a source's documents, and so as large:
a source with a third of all rows is never sorted as one group. What comes of it is one small row (passes, block, last
hash), with which documents are picked where they lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

STEPS = 1_000_000
SECTIONS = 32
_SPACE = float(1 << 52)


def least_step(holds: Callable[[list[int]], list[bool]]) -> int:
    """The smallest exponent in steps for which a monotonic condition holds, STEPS if none does below; each round tries
    SECTIONS exponents at once, in one job."""
    low, high = -1, STEPS  # it fails at low and holds at high
    while high - low > 1:
        tries = sorted({low + max(1, (high - low) * i // (SECTIONS + 1)) for i in range(1, SECTIONS + 1)} - {high})
        good = holds(tries)
        first = next((i for i, g in enumerate(good) if g), len(tries))
        low, high = (tries[first - 1] if first else low), (tries[first] if first < len(tries) else high)
    return high


def exponent(stats: DataFrame, *, max_repeats: float | None, target_entropy: float | None) -> int:
    """The exponent in steps of 10^-6. Repeats fall as it grows: the smallest that meets `max_repeats`. Entropy (nats)
    falls too: the largest that still reaches `target_entropy`, 0 if none does."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")
    some = stats.where("tokens > 0")
    top = some.agg(F.max("tokens")).first()[0]
    if top is None:
        return STEPS
    if max_repeats is not None:
        def repeats(tries: list[int]) -> list[bool]:
            row = some.agg(*(F.max(F.pow(F.lit(float(top)) / F.col("tokens"), F.lit(1 - k / STEPS))) for k in tries)).first()
            return [x <= max_repeats for x in row]

        return least_step(repeats)

    def too_low(tries: list[int]) -> list[bool]:
        w = [F.pow(F.col("tokens") / F.lit(float(top)), F.lit(k / STEPS)) for k in tries]
        row = some.agg(*(F.sum(x) for x in w), *(F.sum(x * F.log(x)) for x in w)).first()
        n = len(tries)
        import math

        return [math.log(row[i]) - row[n + i] / row[i] < target_entropy for i in range(n)]

    return max(0, least_step(too_low) - 1) if too_low([STEPS])[0] else STEPS


def _own(key: Column, text: Column) -> Column:
    """What tells a row of its source from others: rows that have a key in common, or none, differ by their texts."""
    return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))


def _hash(own: Column, turn: Column, seed: int) -> Column:
    """52 bits that order a pass; the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), own)), 1, 13), 16, 10).cast("long")


def plan(slim: DataFrame, *, max_repeats: float | None, target_entropy: float | None, budget_tokens: int | None, seed: int) -> DataFrame:
    """Per source: weight, passes (whole ones), block and last (where the last pass ends), blocks, repeats.

    `slim`: _s (source, never null), _k (what tells a row from others), tokens.
    """
    stats = written(slim.groupBy("_s").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-stats")
    a = exponent(stats, max_repeats=max_repeats, target_entropy=target_entropy) / STEPS
    total = stats.where("tokens > 0").agg(F.max("tokens").cast("double"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a)))).first()
    top, norm = total[0] or 1.0, total[1] or 1.0
    power = F.pow(F.col("tokens").cast("double"), F.lit(a))
    weight = F.when(F.col("tokens") > 0, power / F.lit(norm)).otherwise(0.0)
    share = F.pow(F.lit(top) / F.col("tokens"), F.lit(1 - a)) * F.col("tokens") if budget_tokens is None else F.lit(float(budget_tokens)) * weight
    sized = stats.withColumn("weight", weight).withColumn("budget", F.when(F.col("tokens") > 0, F.floor(share + 0.5)).otherwise(0).cast("long"))
    sized = sized.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.expr("budget div tokens"))).otherwise(1).cast("long"))
    sized = sized.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0))
    sized = sized.withColumn("blocks", F.ceil(F.sqrt("docs")).cast("long"))
    sized = sized.withColumn("repeats", F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(1.0))
    sized = written(sized, "mix-sized")
    h = _hash(F.col("_k"), F.col("passes"), seed)
    last = slim.join(sized.select("_s", "passes", "rest", "blocks"), "_s").where("rest > 0").withColumn("h", h).withColumn("block", F.floor(F.col("h") / _SPACE * F.col("blocks")).cast("long"))
    sums = last.groupBy("_s", "rest", "block").agg(F.sum("tokens").alias("t"))
    run = sums.withColumn("upto", F.sum("t").over(Window.partitionBy("_s").orderBy("block")))
    edge = run.where("upto > rest").groupBy("_s").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("upto") + F.col("t")).alias("room")), "block").alias("e")).select("_s", "e.*")
    edge = written(edge, "mix-edge")
    # rows of equal hash are repeats in key and text: they count together, and none is in where the budget can't take all
    before = F.coalesce(F.sum("t").over(Window.partitionBy("_s").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = last.join(edge, ["_s", "block"]).groupBy("_s", "room", "h").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).withColumn("before", before)
    cut = inside.where("before < room AND (n = 1 OR before + t <= room)").groupBy("_s").agg(F.max("h").alias("last"))
    return written(sized.join(edge.select("_s", "block"), "_s", "left").join(cut, "_s", "left").select("_s", "weight", "budget", "passes", "blocks", "repeats", F.coalesce("block", F.lit(-1)).alias("block"), F.coalesce("last", F.lit(-1)).alias("last")), "mix-plan")


def mix(docs: DataFrame, *, max_repeats: float | None = None, target_entropy: float | None = None, budget_tokens: int | None = None, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """The rows of `docs`, each as often as its source's budget takes it, with `mix_pass` (from 0) and `mix_rank`.

    Ordering by mix_rank (0 to 1) runs through all sources evenly, in proportion to their weights. Tokens default to
    words. A null source is a source of its own, a null key hashes as an empty one, so that rows which share a key are
    told apart by their texts. Rows that repeat key and text are taken together: the last pass has none of them where
    its budget doesn't reach for all, so no limit on repeats is passed. A source without tokens is used once; an empty
    table gives an empty one. Only the columns named mix_pass and mix_rank would clash: they're replaced.
    """
    own = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    tokens = word_count(F.col(text)) if tokens is None else tokens
    slim = written(docs.select(own.alias("_s"), _own(F.col(key), F.col(text)).alias("_k"), tokens.alias("tokens")), "mix-slim")
    return realise(docs, plan(slim, max_repeats=max_repeats, target_entropy=target_entropy, budget_tokens=budget_tokens, seed=seed), seed=seed, key=key, text=text, source=own)


def realise(docs: DataFrame, plan: DataFrame, *, seed: int, key: str, text: str, source: Column) -> DataFrame:
    """Pick rows by the plan, a small table that Spark broadcasts if its size allows; no text is shuffled then."""
    names = [c for c in docs.columns if c not in ("mix_pass", "mix_rank")]
    own = "_"
    while any(c.startswith(own) for c in names):  # columns of docs keep their names, whatever they are
        own += "_"
    s, p, ps, h, k = (own + c for c in ("s", "p", "ps", "h", "k"))
    small = plan.select(F.struct("passes", "blocks", "repeats", "block", "last").alias(p), F.col("_s").alias(ps))
    turns = docs.select(*names, source.alias(s), _own(F.col(key), F.col(text)).alias(k)).join(small, F.col(s) == F.col(ps)).withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col(p)["passes"])))
    picked = turns.withColumn(h, _hash(F.col(k), F.col("mix_pass"), seed))
    block = F.floor(F.col(h) / _SPACE * F.col(p)["blocks"])
    taken = (F.col("mix_pass") < F.col(p)["passes"]) | (block < F.col(p)["block"]) | ((block == F.col(p)["block"]) & (F.col(h) <= F.col(p)["last"]))
    return picked.where(taken).withColumn("mix_rank", (F.col("mix_pass") + F.col(h) / _SPACE) / F.col(p)["repeats"]).select(*names, "mix_pass", "mix_rank")
