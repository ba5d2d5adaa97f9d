from larkspur.streaming import events as E

SF = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/events.parquet")
    log.repartition(6).write.parquet(str(tmp_path / "log"))
    return log, E.source(spark, str(tmp_path / "log"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", 2)


def test_daily_counts_match_batch(spark, tmp_path):
    log, live = stream(spark, tmp_path)
    got = E.over_quota(E.drain(E.daily_counts(live, ["user_id"]), "daily", str(tmp_path / "c")), 2)
    wanted = E.over_quota(E.daily_counts(log, ["user_id"]), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_latest_state_matches_batch(spark, tmp_path):
    log, live = stream(spark, tmp_path)
    got = E.drain(E.latest_state(live, "user_id", "ts", "event_id", "event_type"), "latest", str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.latest_state(log, "user_id", "ts", "event_id", "event_type").collect()))


def test_once(spark, tmp_path):
    log, live = stream(spark, tmp_path)
    got = E.drain(E.once(live.unionByName(live), ["event_id"], late="400 days").select("event_id"), "once", str(tmp_path / "c"), "append")
    assert got.count() == log.select("event_id").distinct().count()


def test_batches_and_append_log(spark, tmp_path):
    log, live = stream(spark, tmp_path)
    seen = tmp_path / "seen"
    E.drain_batches(live.select("event_id"), str(tmp_path / "c1"), lambda frame, i: frame.write.mode("overwrite").parquet(str(seen / f"batch={i}"))).awaitTermination()
    assert spark.read.parquet(str(seen)).select("event_id").count() == log.count()
    for _ in range(2):  # the second run finds nothing new
        E.append_log(live, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == log.count()
