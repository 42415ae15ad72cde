import time


from threadloom.streaming import quiet


def test_bursts_that_follow_closely_are_one(spark, tmp_path):
    """Two bursts nearer than the quiet time give one refresh, a later one gives another."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", quiet.ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    landing, seen = str(tmp_path / "in"), []
    schema = "scope string, path string, gone boolean"
    write = lambda rows: session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    write([("r", "/warm", False)])
    stream = session.readStream.schema(schema).parquet(landing)
    q = quiet.start_quiet_refresh(stream, lambda batch, n: seen.append(sorted(map(tuple, batch.collect()))), checkpoint=str(tmp_path / "cp"), quiet_ms=6000)

    def until(n):
        end = time.time() + 120
        while len(seen) < n and time.time() < end:
            assert q.exception() is None, q.exception()
            time.sleep(0.2)

    try:
        until(1)
        write([("r", "/a", False), ("r", "/b", False), ("r", None, False)])
        time.sleep(1.5)
        write([("r", "/a", True), ("r", "/c", None)])
        until(2)
        time.sleep(1)
        write([("r", "/d", False)])
        until(3)
    finally:
        q.stop()
    assert seen == [[("/warm", False)], [("/a", True), ("/b", False), ("/c", False)], [("/d", False)]]
