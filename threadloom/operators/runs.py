"""Segmented scans: what depends on all earlier rows of a session, for sessions of any size.

A session of up to a run's rows is a window of its own. A longer one is cut into runs, ranges of its order; each run gives
one row with what later runs need of it (counts, bytes, last values), these rows are summed up along the session, and what
comes out is handed to the run's own rows. So no task holds more than a run or the rows of its carries, whatever share of
the table one session has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.shared import new_path

RUN_ROWS = 1_000_000
#: There are no more runs than this, and fewer sessions than this are cut: runs grow beyond it instead.
MOST_RUNS = 20_000


def in_runs(df: DataFrame, keys: list[str], order: list[str], run_rows: int | None = RUN_ROWS) -> tuple[DataFrame, bool]:
    """df with `_run`, and whether anything was cut: -1 in sessions (rows that agree in `keys`, nulls too) of at most run_rows
    rows, else ascending numbers along `order`. Rows of equal order are in one run.

    df is counted, and read once more for the long sessions, whose rows are written to the shared folder. Where no session
    is long nothing is written. With run_rows None no session is cut, and df isn't counted.
    """
    whole = df.withColumn("_run", F.lit(-1))
    if run_rows is None:
        return whole, False
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if (most or 0) <= run_rows:
        return whole, False
    rows = max(run_rows, total // MOST_RUNS)
    path = new_path(df.sparkSession, "long-sessions")
    sizes.where(F.col("_n") > rows).write.parquet(path)
    long = df.sparkSession.read.schema(sizes.schema).parquet(path)
    of_long = long.agg(F.sum("_n")).first()[0] or 0
    if not of_long:
        return whole, False
    names = long.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))  # fewer than MOST_RUNS rows
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    cut = df.join(F.broadcast(names), same, "left_semi").repartitionByRange(-(-of_long // rows), *keys, *order).withColumn("_run", F.spark_partition_id())
    path = new_path(df.sparkSession, "runs")
    cut.write.parquet(path)
    return df.join(F.broadcast(names), same, "left_anti").withColumn("_run", F.lit(-1)).unionByName(df.sparkSession.read.schema(cut.schema).parquet(path)), True


def carry(rows: DataFrame, keys: list[str], of_run: dict[str, Column], along: dict[str, tuple[Column, bool]]) -> DataFrame:
    """rows with the columns `along`, null in sessions that aren't cut. of_run: aggregates of a run's rows; along: aggregates of
    those over the earlier runs of the session (True) or over all of its runs (False).

    There's a row for each session in each run, and only sessions of more rows than a run are cut: fewer than two rows for
    each of at most MOST_RUNS runs, so they are broadcast.
    """
    each = rows.where("_run >= 0").groupBy(*keys, "_run").agg(*(c.alias(name) for name, c in of_run.items()))
    w = Window.partitionBy(*keys)
    earlier = w.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    summed = each.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_run").alias("_of"), *(c.over(earlier if before else w).alias(name) for name, (c, before) in along.items()))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_run") == F.col("_of"))
    return rows.join(F.broadcast(summed), same, "left").select(*rows.columns, *along)
