"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Collection, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: Places by run. Each thread starts outside of any run; what it makes there is in a list of its own.
_made: ContextVar[list[str] | None] = ContextVar("places", default=None)


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where that is unset a local run makes a new folder, as driver and executors
    are one process there; anywhere else it's an error."""
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="threadloom-")
    spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def _places() -> list[str]:
    if (made := _made.get()) is None:
        _made.set(made := [])
    return made


@contextmanager
def run() -> Iterator[None]:
    """A run with places of its own: within it `places` and `forget` know what this run has made and nothing else, whatever
    other runs and threads do meanwhile. What it hasn't forgotten at its end belongs to what is around it."""
    around = _places()
    token = _made.set([])
    try:
        yield
    finally:
        around += _places()
        _made.reset(token)


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; `forget` deletes what was written there."""
    made = _places()
    made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return made[-1]


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a new place and read from there: what is read more than once is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def places() -> set[str]:
    """The places that `new_path` gave this run and `forget` hasn't deleted."""
    return set(_places())


def forget(spark: SparkSession, keep: Collection[str] = ()) -> int:
    """Delete what this run has written to places that `new_path` gave, but for `keep`; how many places that were. Results
    that still read them fail afterwards, so it's for when these are written or no longer needed."""
    made = _places()
    gone = [p for p in made if p not in keep]
    for place in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    made[:] = [p for p in made if p in keep]
    return len(gone)


def rename(spark: SparkSession, place: str, ending: str, to: str) -> None:
    """Give the files right below a place, or below its folders, another ending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for pattern in ("*", "*/*"):
        for f in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{pattern}{ending}")) or []:
            old = f.getPath()
            system.rename(old, spark._jvm.org.apache.hadoop.fs.Path(old.getParent(), old.getName().removesuffix(ending) + to))
