"""A change feed that waits for quiet: changes are collected until none has come for a while, then come out as one burst."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

QUIET_MS = 350
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BURST = "scope string, burst long, path string, gone boolean"
#: Rows handed on at a time.
ROWS = 10_000


class Collector(StatefulProcessor):
    """Changed paths of a scope, the last word on each, and one timer that every further change puts off."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            for path, gone in zip(some["path"], some["gone"], strict=True):
                self.paths.updateValue((path,), (bool(gone),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        burst, some = expiredTimerInfo.getExpiryTimeInMs(), []
        for (path,), (gone,) in self.paths.iterator():
            some.append((key[0], burst, path, gone))
            if len(some) == ROWS:
                yield pd.DataFrame(some, columns=["scope", "burst", "path", "gone"])
                some = []
        self.paths.clear()
        if some:
            yield pd.DataFrame(some, columns=["scope", "burst", "path", "gone"])

    def close(self) -> None:
        pass


def quiet_changes(changes: DataFrame, *, quiet_ms: int = QUIET_MS) -> DataFrame:
    """scope, burst (when it was over, in epoch milliseconds), path, gone: the changes (scope, path, gone) of a stream, each
    path of a scope once a burst, with what was last said of it. A burst of a scope ends once `quiet_ms` have passed without a
    change in it; scopes, such as roots, are independent of each other. A null path is no change; a null gone is false.

    Time is processing time: a change counts when its batch is run, so triggers should be shorter than the quiet time. The
    session's state store must be RocksDB (ROCKSDB as spark.sql.streaming.stateStore.providerClass).
    """
    rows = changes.where("path IS NOT NULL").select(F.coalesce(F.col("scope").cast("string"), F.lit("")).alias("scope"), "path", F.coalesce("gone", F.lit(False)).alias("gone"))
    return rows.groupBy("scope").transformWithStateInPandas(Collector(quiet_ms), BURST, "Append", "ProcessingTime")


def start_quiet_refresh(changes: DataFrame, refresh: Callable[[DataFrame, int], None], *, checkpoint: str, quiet_ms: int = QUIET_MS, interval: str = "100 milliseconds"):
    """`refresh` (changes path and gone, number of the batch) once for each burst, or for bursts of several scopes that end
    together; batches in which no burst ends do nothing."""

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                refresh(batch.groupBy("path").agg(F.max_by("gone", "burst").alias("gone")), n)
        finally:
            batch.unpersist()

    return quiet_changes(changes, quiet_ms=quiet_ms).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
