"""Incremental refresh: only new or changed files are read again, vanished ones are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.edit import row_hash
from threadloom.streaming import store


def reuse_index(manifest: DataFrame, index: DataFrame, keys: list[str], *, parser_version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifest rows to read anew, and index rows that still hold: all of `keys` (path, size, time, …) are equal. With a
    parser_version, index rows of another one (a column of that name) don't hold: new rules mean a full rebuild."""
    if parser_version is not None:
        index = index.where(F.col("parser_version") == parser_version)
    return manifest.join(index.select(*keys), keys, "left_anti"), index.join(manifest.select(*keys), keys, "left_semi")


def upsert_index(reusable: DataFrame, fresh: DataFrame) -> DataFrame:
    return reusable.unionByName(fresh)


def prune_missing(index: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    return index.join(manifest.select(path).distinct(), path, "left_semi")


def start_refresh_stream(spark: SparkSession, source_dir: str, schema: str, refresh: Callable[[DataFrame, int], None], *, checkpoint: str, interval: str = "1 second"):
    """One refresh for each micro-batch of newly landed Parquet files; a burst of files is one batch."""
    files = spark.readStream.schema(schema).parquet(source_dir)
    return files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def refresh_paths(rows: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows (file_path, session_key, …) after changes (path, gone): rows of changed paths go, and of all paths below a
    directory that is gone; `fresh`, the summaries of what is there now, come in, unless another file has their key."""
    kept = rows.join(store.affected(rows, changed), "file_path", "left_anti")
    return kept.unionByName(fresh.join(kept.select("session_key").distinct(), "session_key", "left_anti").select(*rows.columns))


def refresh_store(store_dir: str, summarize: Callable[[DataFrame], DataFrame], *, path: str = "file_path", buckets: int = store.BUCKETS) -> Callable[[DataFrame, int], None]:
    """A refresh for `start_refresh_stream`: each batch is the next version of the store, in which only buckets of its files
    are written. A batch that runs again after it was committed changes nothing."""

    def refresh(batch: DataFrame, n: int) -> None:
        changed = batch.select(F.col(path).alias("path"), F.lit(False).alias("gone")).distinct()
        store.apply(store_dir, changed, summarize(batch), batch=n, buckets=buckets)

    return refresh


def artifact_hint_fingerprint(artifacts: DataFrame) -> DataFrame:
    """session, fingerprint of its user artifacts (session, role, text): another one means that what was found to repeat
    them is stale. Hashes are added up, so order doesn't matter."""
    own = artifacts.where("role = 'user'").groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum(row_hash("text")).alias("h"))
    return own.select("session", F.concat_ws(":", F.col("n").cast("string"), F.col("h").cast("string")).alias("fingerprint"))
