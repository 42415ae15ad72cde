"""A store of summaries that is refreshed in place without being rewritten: buckets by path, each a base and deltas.

    data/set=<id>/bucket=<k>/…   files that are written once and never changed
    versions/v<n>                which of them make up version n: JSON, put there by a rename

A batch writes one delta to each bucket that it touches: rows of the files that changed, and a mark for each file that
went. A version is there as a whole or not at all, and a reader keeps what it began with. A bucket that has many deltas
gets a new base when it's next written. What no version refers to any more is deleted by `vacuum`.

A delta takes the place of all rows that its files had before; rows of one file come together, from its last change.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 256
#: Deltas that a bucket may have before its base is written anew.
MOST_DELTAS = 8


@dataclass
class Version:
    number: int = -1
    batch: int = -1
    buckets: int = BUCKETS
    columns: str = ""
    #: Of each bucket that isn't empty its sets of files, the base first, each with the version that it came with.
    files: dict[str, list[tuple[int, str]]] = field(default_factory=dict)


def _system(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, store_dir: str) -> list[int]:
    path, system = _system(spark, f"{store_dir}/versions")
    names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)))


def version(spark: SparkSession, store_dir: str, number: int | None = None) -> Version:
    """A version of the store, the last one unless told; before the first there is an empty one, of number -1."""
    if number is None:
        numbers = _numbers(spark, store_dir)
        if not numbers:
            return Version()
        number = numbers[-1]
    path, system = _system(spark, f"{store_dir}/versions/v{number:010d}")
    stream = system.open(path)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(**found | {"files": {k: [tuple(x) for x in v] for k, v in found["files"].items()}})


def _commit(spark: SparkSession, store_dir: str, new: Version) -> None:
    """Put the version there by a rename, which fails if another writer was first."""
    pending, system = _system(spark, f"{store_dir}/versions/.{uuid.uuid4().hex}")
    stream = system.create(pending)
    stream.write(bytearray(json.dumps(asdict(new)).encode()))
    stream.close()
    target, _ = _system(spark, f"{store_dir}/versions/v{new.number:010d}")
    if system.exists(target) or not system.rename(pending, target):
        system.delete(pending, False)
        raise RuntimeError(f"another writer has made version {new.number} of {store_dir}")


def _bucket(path: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(n)).cast("int")


def _load(spark: SparkSession, store_dir: str, v: Version, buckets: set[str] | None = None) -> DataFrame | None:
    """Rows of the buckets as they are in this version, with `bucket`; None if there are none."""
    some = {k: x for k, x in v.files.items() if buckets is None or k in buckets}
    schema = f"{v.columns}, _gone boolean, _came long, set string, bucket int"
    read = lambda places: spark.read.schema(schema).option("basePath", f"{store_dir}/data").parquet(*places) if places else None
    places = lambda keep: [f"{store_dir}/data/set={d}/bucket={k}" for k, x in some.items() if keep(x) for _, d in x]
    bare, mixed = read(places(lambda x: len(x) == 1)), read(places(lambda x: len(x) > 1))
    if mixed is not None:
        last = F.max("_came").over(Window.partitionBy("bucket", "file_path"))  # of a file's rows those of its last change
        mixed = mixed.withColumn("_last", last).where("_came = _last").drop("_last")
    both = bare if mixed is None else mixed if bare is None else bare.unionByName(mixed)
    return None if both is None else both.where("NOT _gone").drop("_gone", "_came", "set")


def read(spark: SparkSession, store_dir: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the last one unless told."""
    v = version(spark, store_dir, number)
    if not v.columns:
        raise FileNotFoundError(f"{store_dir} has no version yet")
    rows = _load(spark, store_dir, v)
    return spark.createDataFrame([], v.columns) if rows is None else rows.drop("bucket")


def _write(df: DataFrame, store_dir: str) -> tuple[str, list[str]]:
    """Rows as a new set of files by bucket; its name, and the buckets that it has."""
    name = uuid.uuid4().hex
    df.repartition("bucket").write.partitionBy("bucket").parquet(f"{store_dir}/data/set={name}")
    path, system = _system(df.sparkSession, f"{store_dir}/data/set={name}")
    names = [f.getPath().getName() for f in system.listStatus(path)]
    return name, [n.removeprefix("bucket=") for n in names if n.startswith("bucket=")]


def replace(store_dir: str, rows: DataFrame, *, batch: int = -1, buckets: int = BUCKETS) -> Version:
    """All rows anew, as the bases of the next version."""
    spark = rows.sparkSession
    old = version(spark, store_dir)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    new = Version(old.number + 1, batch, buckets, columns)
    full = rows.withColumns({"_gone": F.lit(False), "_came": F.lit(new.number).cast("long"), "bucket": _bucket(F.col("file_path"), buckets)})
    name, found = _write(full, store_dir)
    new.files = {k: [(new.number, name)] for k in found}
    _commit(spark, store_dir, new)
    return new


def affected(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """file_path of the rows that changes (path, gone) touch: that file itself, and all below a directory that is gone. Paths
    are looked up by themselves and by their parents, as equal keys."""
    labels = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.lit(1), i), "/"))
    ways = rows.select("file_path").distinct().select("file_path", F.explode(above).alias("path"))
    hit = ways.join(changed.select("path", "gone").distinct(), "path").where((F.col("path") == F.col("file_path")) | F.col("gone"))
    return hit.select("file_path").distinct()


def apply(store_dir: str, changed: DataFrame, fresh: DataFrame, *, batch: int = -1, buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS) -> Version:
    """The next version, after changes (path, gone): rows of changed paths go, and `fresh`, what is there now (file_path,
    session_key, …), comes in, unless a file that stays has its key. A batch that is in the store already (a number that
    isn't above the last one's) changes nothing, so one that runs again does no harm.

    Of the store's other buckets two columns are read, file_path and session_key, and nothing is written.
    """
    spark = fresh.sparkSession
    old = version(spark, store_dir)
    if batch >= 0 and batch <= old.batch:
        return old
    rows = _load(spark, store_dir, old) if old.columns else None
    if rows is None:
        return replace(store_dir, fresh, batch=batch, buckets=old.buckets if old.columns else buckets)
    hit = affected(rows, changed)
    kept = rows.join(hit, "file_path", "left_anti").select("session_key").distinct()
    names = [c for c in rows.columns if c != "bucket"]
    number = old.number + 1
    came = {"_came": F.lit(number).cast("long"), "bucket": _bucket(F.col("file_path"), old.buckets)}
    come = fresh.join(kept, "session_key", "left_anti").select(*names).withColumn("_gone", F.lit(False))
    went = hit.select("file_path").withColumn("_gone", F.lit(True))
    delta = come.unionByName(went, allowMissingColumns=True).select(*names, "_gone").withColumns(came)
    name, found = _write(delta, store_dir)
    files = {k: list(x) for k, x in old.files.items()}
    for k in found:
        files.setdefault(k, []).append((number, name))
    new = Version(number, batch if batch >= 0 else old.batch, old.buckets, old.columns, files)
    if full := {k for k in found if len(files[k]) > most_deltas}:
        compacted = _load(spark, store_dir, new, full).withColumns({"_gone": F.lit(False), "_came": F.lit(number).cast("long")})
        base, left = _write(compacted, store_dir)
        for k in full:
            if k in left:
                files[k] = [(number, base)]
            else:
                del files[k]
    _commit(spark, store_dir, new)
    return new


def vacuum(spark: SparkSession, store_dir: str, keep: int = 2) -> int:
    """Delete all but the last `keep` versions, and the files that none of these refers to; how many sets of files went. Not
    while a writer is at work: what it has written so far belongs to no version yet."""
    numbers = _numbers(spark, store_dir)
    held = {d for n in numbers[-keep:] for x in version(spark, store_dir, n).files.values() for _, d in x}
    for n in numbers[:-keep]:
        path, system = _system(spark, f"{store_dir}/versions/v{n:010d}")
        system.delete(path, False)
    path, system = _system(spark, f"{store_dir}/data")
    gone = [f.getPath() for f in system.listStatus(path) if f.getPath().getName().removeprefix("set=") not in held] if system.exists(path) else []
    for p in gone:
        system.delete(p, True)
    return len(gone)


@dataclass(frozen=True)
class Source:
    root: str
    kind: str
    #: Files of one session each, or arrays that sessions share.
    shared_arrays: bool = False


def below(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return (path == root) | F.startswith(path, F.lit(f"{root}/"))


def needs_full_refresh(changed: DataFrame, sources: list[Source], before: list[Source]) -> bool:
    """Whether changed paths aren't enough to go by: another set of sources than before, as no path tells which sessions came
    or went with one; or a change below a source of shared arrays, whose sessions have their records in several files."""
    if set(sources) != set(before):
        return True
    arrays = [s.root for s in sources if s.shared_arrays]
    return any(not changed.where(below(F.col("path"), r)).isEmpty() for r in arrays)


def refresh(store_dir: str, changed: DataFrame, summarize: Callable[[DataFrame], DataFrame], summarize_all: Callable[[], DataFrame], *, sources: list[Source], before: list[Source], batch: int = -1, buckets: int = BUCKETS) -> Version:
    """The next version after changes (path, gone) below the sources; others count for nothing. `summarize` gives the rows of
    the changed paths that are still there, `summarize_all` all rows, for when a full refresh is needed."""
    if needs_full_refresh(changed, sources, before):
        return replace(store_dir, summarize_all(), batch=batch, buckets=buckets)
    inside = F.lit(False)
    for s in sources:
        inside = inside | below(F.col("path"), s.root)
    own = changed.where(inside)
    return apply(store_dir, own, summarize(own), batch=batch, buckets=buckets)
