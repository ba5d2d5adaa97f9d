"""Stateful streams: stopped, started again from the checkpoint, and held against folds over the whole table."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from larkspur.operators import state
from larkspur.streaming import events as E
from larkspur.streaming import stateful

SF = "/root/testdata/sf0.001"


def feed(frame, folder, n):
    """One more file; files are read in order of their time."""
    frame.coalesce(1).write.mode("append").parquet(str(folder))
    for f in folder.glob("*.parquet"):
        if f.stat().st_mtime > time.time() - 3600:
            os.utime(f, (1_600_000_000 + 10 * n, 1_600_000_000 + 10 * n))


def run(df, name, folder, log):
    E.append_log(df, str(log), str(folder / f"checkpoint-{name}")).awaitTermination()


def test_saves_go_on_after_a_restart(spark, tmp_path):
    saves = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 4).cast("bigint").alias("expected")).where("user_id < 60")
    wanted = state.versioned_saves(saves, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "accepted", "version").collect()
    cuts = saves.approxQuantile("event_id", [0.25, 0.5, 0.75], 0)
    marks = [r[0] for r in saves.select("ts").orderBy("ts").collect()]
    marks = [marks[len(marks) * i // 4] for i in (1, 2, 3)]
    parts = [saves.where((F.col("ts") >= lo) & (F.col("ts") < hi)) for lo, hi in zip([dt.datetime(1900, 1, 1), *marks], [*marks, dt.datetime(2200, 1, 1)])]
    assert len(cuts) == 3 and sum(p.count() for p in parts) == len(wanted)
    for n, part in enumerate(parts):
        feed(part, tmp_path / "in", n)
        if n in (1, 3):  # stopped in between
            live = E.source(spark, str(tmp_path / "in"), "user_id long, event_id long, ts timestamp, expected long", 1)
            run(stateful.versioned_saves(live, ["user_id"], ["ts", "event_id"]), "saves", tmp_path, tmp_path / "out")
    got = spark.read.parquet(str(tmp_path / "out")).select("user_id", "event_id", "accepted", "version").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and any(r["version"] > 1 for r in got)


def test_leases_run_out(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "job string, at timestamp, action string, worker string"
    rows = [
        [("a", at(0), "add", None), ("a", at(1), "claim", "w1"), ("a", at(2), "claim", "w2"), ("b", at(0), "add", None), ("b", at(1), "claim", "w1"), ("b", at(3), "done", "w1"), ("c", at(1), "claim", "w9")],
        [("d", at(30), "add", None), ("b", at(31), "add", None)],
        [("a", at(40), "claim", "w3"), ("a", at(41), "done", "w1"), ("a", at(42), "fail", "w3"), ("a", at(43), "claim", "w1"), ("a", at(44), "add", None), ("a", at(59), "done", "w1")],
    ]
    for n, part in enumerate(rows):
        feed(spark.createDataFrame(part, schema), tmp_path / "in", n)
        live = E.source(spark, str(tmp_path / "in"), schema, 1)
        run(stateful.leased_jobs(live, 10_000), "jobs", tmp_path, tmp_path / "out")
    got = sorted((r["job"], r["at"].second, r["action"], r["worker"], r["ok"], r["attempts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [r for r in got if r[0] == "a"] == [
        ("a", 0, "add", "", True, 0), ("a", 1, "claim", "w1", True, 1), ("a", 2, "claim", "w2", False, 1), ("a", 11, "expired", "w1", True, 1), ("a", 40, "claim", "w3", True, 2), ("a", 41, "done", "w1", False, 2),
        ("a", 42, "fail", "w3", True, 2), ("a", 43, "claim", "w1", True, 3), ("a", 44, "add", "", False, 3), ("a", 53, "expired", "w1", True, 3), ("a", 59, "done", "w1", False, 3),
    ]
    assert [r for r in got if r[0] == "b"] == [("b", 0, "add", "", True, 0), ("b", 1, "claim", "w1", True, 1), ("b", 3, "done", "w1", True, 1), ("b", 31, "add", "", True, 0)]
    assert [r for r in got if r[0] in "cd"] == [("c", 1, "claim", "w9", False, 0), ("d", 30, "add", "", True, 0)]
