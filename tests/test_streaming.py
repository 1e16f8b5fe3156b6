"""True streams over files equal their batch forms."""

from folioscope.streaming import progress as P


def run(df, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(f"t{abs(hash(str(tmp_path)))}").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(q.name)


def source(spark, sf, tmp_path, parts=3):
    out = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value").repartitionByRange(parts, "ts").write.parquet(out)
    return out


def test_tumbling(spark, sf, tmp_path):
    path = source(spark, sf, tmp_path)
    got = run(P.tumbling(P.read_events(spark, path), late="1000 days"), tmp_path, "complete")
    want = P.tumbling(spark.read.parquet(path))
    assert sorted((r.start, r.event_type, r.n) for r in got.collect()) == sorted((r.start, r.event_type, r.n) for r in want.collect())


def test_ema_state_goes_on_between_batches(spark, sf, tmp_path):
    path = source(spark, sf, tmp_path, 1)
    got = {}
    for r in run(P.ema_stream(P.read_events(spark, path)), tmp_path, "update").collect():
        if r.user_id not in got or r.n > got[r.user_id][1]:
            got[r.user_id] = (r.rate, r.n)
    want = {r.user_id: r.rate for r in P.ema(spark.read.parquet(path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[u][0] - want[u]) < 1e-9 for u in want)


def test_duplicates_go_within_the_watermark(spark, sf, tmp_path):
    path = source(spark, sf, tmp_path)
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    assert run(P.deduplicated(P.read_events(spark, path + "2", 100)), tmp_path, "append").count() == spark.read.parquet(path).count()


def test_memory_grows_and_a_restart_reads_new_files_only(spark, tmp_path):
    """Two runs of the same query; the second one goes on from the checkpoint."""
    import datetime as dt

    path, folder = str(tmp_path / "replies"), str(tmp_path / "memory")
    put = lambda *rows: spark.createDataFrame([(k, t, dt.datetime(2024, 1, 1, h)) for k, t, h in rows], "key string, target string, ts timestamp").coalesce(1).write.mode("append").parquet(path)

    def go():
        stream = spark.readStream.schema("key string, target string, ts timestamp").parquet(path)
        q = P.grow_memory(stream, folder, "1000 days").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    put(("a", "old", 1), ("b", "b", 1), ("a", "old", 2))
    go()
    put(("a", "new", 3), ("c", "c", 2))
    q = go()
    assert sum(p["numInputRows"] for p in q.recentProgress) == 2
    assert sorted((r.key, r.target) for r in P.memory_at(spark, folder).collect()) == [("a", "new"), ("b", "b"), ("c", "c")]
    assert P.memory_at(spark, str(tmp_path / "none")) is None
