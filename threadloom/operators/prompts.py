"""Prompts that the messages of their session repeat, found by one automaton of a session's prompts.

Each message is read once, whatever the number of prompts: an Aho-Corasick automaton of all that is looked for in its session
streams over it. Sessions are dealt into buckets of about BUCKET_BYTES of messages, a task for each. A session that has
more is dealt over several buckets with its prompts copied to each, and one of more than PROMPTS different prompts has
several automata; its messages are read once for each of these.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 64 << 20
PROMPTS = 20_000
#: Fewer sessions than this are dealt over several buckets or automata: what a task holds grows instead.
MOST_LARGE = 20_000


def _parts(df: DataFrame, session: str, weight, most: int, name: str) -> DataFrame:
    """df with `name`: how many parts its session has, by the sum of a weight that no part shall have more of than `most`."""
    sizes = df.groupBy(session).agg(F.sum(weight).alias("_w"))
    total = sizes.agg(F.sum("_w")).first()[0] or 0
    most = max(most, total // MOST_LARGE)
    large = sizes.where(F.col("_w") > most).select(session, F.ceil(F.col("_w") / most).cast("int").alias(name))  # fewer than MOST_LARGE
    return df.join(F.broadcast(large), session, "left").withColumn(name, F.coalesce(name, F.lit(1)))


def _find(prompts: pa.Table, messages: pa.Table) -> pa.Table:
    """bucket's prompts (session, m, k, value) that one of its messages (session, m, k, value) of the same session and parts holds."""
    own: dict[tuple, list[str]] = {}
    for session, m, k, value in zip(*(prompts.column(c).to_pylist() for c in ("session", "m", "k", "value")), strict=True):
        own.setdefault((session, m, k), []).append(value)
    texts: dict[tuple, list[int]] = {}
    for i, at in enumerate(zip(*(messages.column(c).to_pylist() for c in ("session", "m", "k")), strict=True)):
        if at in own:
            texts.setdefault(at, []).append(i)
    column, found = messages.column("value"), set()
    for at, places in texts.items():
        automaton = ahocorasick.Automaton()
        for value in own[at]:
            automaton.add_word(value, value)
        automaton.make_automaton()
        for i in places:
            found.update((at[0], value) for _, value in automaton.iter(column[i].as_py()))
    cols = [*zip(*found, strict=True)] or [[], []]
    return pa.table({"session": pa.array(cols[0], pa.string()), "value": pa.array(cols[1], pa.string())})


def contained(prompts: DataFrame, messages: DataFrame, *, bucket_bytes: int = BUCKET_BYTES, most_prompts: int = PROMPTS) -> DataFrame:
    """session and value of the prompts (session, value: strings, not empty) that a message (session, value) of their session
    contains, each once. Rows with a null in them neither are found nor hold anything."""
    rows = prompts.dropna().where("value <> ''").select("session", "value").distinct()
    texts = messages.dropna().select("session", "value").join(rows.select("session").distinct(), "session", "left_semi")
    size = F.octet_length("value")
    keyed = _parts(rows, "session", F.lit(1), most_prompts, "_ks").withColumn("k", F.pmod(F.xxhash64("value"), "_ks").cast("int"))
    sized = _parts(texts, "session", size, bucket_bytes, "_ms").withColumn("m", F.pmod(F.xxhash64("value"), "_ms").cast("int"))
    # how many parts the other side has: one row for each session with more than one
    ks = keyed.where("_ks > 1").select("session", "_ks").distinct()
    ms = sized.where("_ms > 1").select("session", "_ms").distinct()
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    wanted = keyed.drop("_ks").join(F.broadcast(ms), "session", "left").select("session", each("_ms").alias("m"), "k", "value")
    read = sized.drop("_ms").join(F.broadcast(ks), "session", "left").select("session", "m", each("_ks").alias("k"), "value")
    total = texts.agg(F.sum(size)).first()[0] or 0
    buckets = max(prompts.sparkSession.sparkContext.defaultParallelism, -(-total // bucket_bytes))
    dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("session", "m", "k"), F.lit(buckets))).groupBy("bucket")
    return dealt(wanted).cogroup(dealt(read)).applyInArrow(_find, "session string, value string").distinct()
