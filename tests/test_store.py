import pathlib
import random

import pytest
from pyspark.sql import functions as F

from threadloom.streaming import store

SCHEMA = "file_path string, session_key string, n int"


def rows(spark, some):
    return spark.createDataFrame(list(some), SCHEMA)


def changes(spark, some):
    return spark.createDataFrame(list(some), "path string, gone boolean")


def test_batches_against_a_plain_store(spark, tmp_path):
    rng = random.Random(9)
    place, want = str(tmp_path / "s"), {}
    name = lambda: f"/r/{rng.choice('abc')}/{rng.randrange(12)}"
    for batch in range(9):
        changed = {name(): False for _ in range(rng.randrange(1, 6))} | ({f"/r/{rng.choice('abc')}": True} if batch % 3 == 2 else {})
        fresh = [(p, f"k{p if rng.random() < 0.8 else rng.randrange(4)}.{i}", rng.randrange(100)) for p in changed if p.count("/") == 3 for i in range(rng.randrange(3))]
        want = {p: x for p, x in want.items() if p not in changed and not any(g and p.startswith(d + "/") for d, g in changed.items())}
        taken = {k for x in want.values() for k, _ in x}
        for p, k, n in fresh:
            if k not in taken:
                want.setdefault(p, []).append((k, n))
        v = store.apply(place, changes(spark, changed.items()), rows(spark, fresh), batch=batch, buckets=5, most_deltas=3)
        assert v.number == batch and max(map(len, v.files.values()), default=0) <= 3
        got = {}
        for r in store.read(spark, place).collect():
            got.setdefault(r.file_path, []).append((r.session_key, r.n))
        assert {p: sorted(x) for p, x in got.items()} == {p: sorted(x) for p, x in want.items()}
        again = store.apply(place, changes(spark, []), rows(spark, [("/x", "x", 1)]), batch=batch)
        assert again.number == batch
    n = store.read(spark, place).count()
    early = store.read(spark, place, 3).count()
    assert store.vacuum(spark, place, keep=6) > 0 and store.read(spark, place, 3).count() == early
    store.vacuum(spark, place, keep=1)
    assert store.read(spark, place).count() == n
    with pytest.raises(Exception, match="(?i)exist"):
        store.read(spark, place, 3)


def test_a_file_of_a_batch_writes_one_bucket(spark, tmp_path):
    place = tmp_path / "s"
    store.apply(str(place), changes(spark, []), rows(spark, ((f"/r/{i}", f"k{i}", i) for i in range(2000))), buckets=32)
    size = lambda: sum(p.stat().st_size for p in place.rglob("*.parquet"))
    base, dirs = size(), {p.name for p in (place / "data").iterdir()}
    store.apply(str(place), changes(spark, [("/r/7", False)]), rows(spark, [("/r/7", "k7", -1)]))
    (new,) = {p.name for p in (place / "data").iterdir()} - dirs
    assert len(list((place / "data" / new).glob("bucket=*"))) == 1 and size() - base < base / 32
    assert store.read(spark, str(place)).where("file_path = '/r/7'").first().n == -1 and store.read(spark, str(place)).count() == 2000


def test_a_reader_sees_whole_versions(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "s")
    store.apply(place, changes(spark, []), rows(spark, [("/a", "a", 1), ("/b", "b", 1)]), buckets=4)
    held = store.read(spark, place)

    def fails(*_):
        raise OSError("no rename")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", fails)  # the data is there, the version isn't
        with pytest.raises(OSError):
            store.apply(place, changes(spark, [("/a", False)]), rows(spark, [("/a", "a", 2)]))
    assert store.read(spark, place).agg(F.sum("n")).first()[0] == 2
    store.apply(place, changes(spark, [("/a", False), ("/b", True)]), rows(spark, [("/a", "a", 5)]))
    assert held.agg(F.sum("n")).first()[0] == 2 and store.read(spark, place).agg(F.sum("n")).first()[0] == 5
    v = store.version(spark, place)
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(spark, place, v)
    assert not [p for p in pathlib.Path(place, "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_full_refresh_rules(spark, tmp_path):
    files, logs = store.Source("/p", "claude_code"), store.Source("/g/", "gemini", shared_arrays=True)
    both = [files, logs]
    needs = lambda paths, sources, before: store.needs_full_refresh(changes(spark, [(p, False) for p in paths]), sources, before)
    assert not needs(["/p/x", "/gg/y"], both, both[::-1])
    assert needs(["/p/x"], both, [files]) and needs([], [files], both) and needs(["/g/tmp/logs.json"], both, both) and needs(["/g"], both, both)
    place = str(tmp_path / "s")
    store.apply(place, changes(spark, []), rows(spark, [("/p/1", "one", 1), ("/p/2", "two", 1)]), buckets=4)
    fresh = lambda changed: changed.select(F.col("path").alias("file_path"), F.concat(F.lit("k"), "path").alias("session_key"), F.lit(9).alias("n"))
    everything = lambda: rows(spark, [("/all", "all", 0)])
    store.refresh(place, changes(spark, [("/p/1", False), ("/other/1", False)]), fresh, everything, sources=both, before=both)
    assert sorted(r.file_path for r in store.read(spark, place).collect()) == ["/p/1", "/p/2"] and store.read(spark, place).agg(F.sum("n")).first()[0] == 10
    store.refresh(place, changes(spark, [("/g/tmp/logs.json", False)]), fresh, everything, sources=both, before=both)
    assert [r.file_path for r in store.read(spark, place).collect()] == ["/all"]


def test_a_store_that_became_empty(spark, tmp_path):
    place = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        store.read(spark, place)
    store.apply(place, changes(spark, []), rows(spark, [("/p/1", "one", 1)]), buckets=4)
    store.apply(place, changes(spark, [("/p", True)]), rows(spark, []), most_deltas=0)
    assert store.read(spark, place).count() == 0 and store.version(spark, place).files == {}
    store.apply(place, changes(spark, [("/p/1", False)]), rows(spark, [("/p/1", "one", 4)]))
    assert store.read(spark, place).first().n == 4
