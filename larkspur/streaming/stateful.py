"""State of keys that outlives micro-batches: versions that saves must expect, and jobs under leases that run out.

Both are arbitrary stateful operators with state in the stream's checkpoint, so a stream that is stopped or loses an executor goes
on from where it was. Rows of a key are taken in order of time within a micro-batch, and micro-batches as they arrive.
A key's rows of one micro-batch are sorted in memory; how many there are is bounded by the source's rate limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the stream's session must be set to before it starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ready(events: DataFrame) -> None:
    events.sparkSession.conf.set(*PROVIDER)


class Versions(StatefulProcessor):
    """A key's version; a save that expects it is accepted and makes the next one."""

    def __init__(self, columns: list[str], order: list[str], ttl_ms: int | None):
        self.columns, self.order, self.ttl_ms = columns, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(rows).sort_values(self.order, kind="stable")
        now = self.version.get()[0] if self.version.exists() else 0
        accepted, versions = [], []
        for expected in rows["expected"]:
            ok = bool(expected == now)
            now += ok
            accepted.append(ok)
            versions.append(now)
        self.version.update((now,))
        yield rows[self.columns].assign(accepted=accepted, version=versions)

    def close(self) -> None:
        pass


def versioned_saves(saves: DataFrame, key: list[str], order: list[str], ttl_ms: int | None = None) -> DataFrame:
    """Adds accepted and version to a stream of saves that each expect a version, as `state.versioned_saves` does to a table.

    With ttl_ms a key that is not saved to for so long (of processing time) starts anew at version 0.
    """
    _ready(saves)
    out = T.StructType([*saves.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("version", T.LongType())])
    mode = "ProcessingTime" if ttl_ms else "None"
    return saves.groupBy(*key).transformWithStateInPandas(Versions(saves.columns, order, ttl_ms), out, "Append", mode)


class Leases(StatefulProcessor):
    """A job's status, worker, attempts and lease; a timer ends a lease that the watermark has passed."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, worker string, attempts int, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, worker, attempts, until = self.job.get() if self.job.exists() else (None, None, 0, 0)
        rows = pd.concat(rows).sort_values(["at", "action", "worker"], kind="stable")
        held = until if status == "processing" else None
        out = []
        for at, action, who in zip(rows["at"], rows["action"], rows["worker"]):
            now = int(at.timestamp() * 1000)
            if status == "processing" and until <= now:
                out.append((pd.Timestamp(until, unit="ms"), "expired", worker, True, attempts))
                status, worker = "pending", None
            ok = False
            if action == "add" and status in (None, "dispatched"):
                ok, status, worker, attempts = True, "pending", None, 0
            elif action == "claim" and status in ("pending", "failed"):
                ok, status, worker, attempts, until = True, "processing", who, attempts + 1, now + self.lease_ms
            elif action in ("done", "fail") and status == "processing" and worker == who:
                ok, status, worker = True, "dispatched" if action == "done" else "failed", None
            out.append((at, action, who, ok, attempts))
        ends = until if status == "processing" else None
        if held is not None and held != ends:
            self.handle.deleteTimer(held)
        if ends is not None and held != ends:
            self.handle.registerTimer(ends)
        if status is not None:
            self.job.update((status, worker, attempts, until))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            status, worker, attempts, until = self.job.get()
            if status == "processing" and until == expiredTimerInfo.getExpiryTimeInMs():
                self.job.update(("pending", None, attempts, until))
                yield self._rows(key, [(pd.Timestamp(until, unit="ms"), "expired", worker, True, attempts)])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["at", "action", "worker", "ok", "attempts"])
        frame.insert(0, "job", key[0])
        return frame.astype({"at": "datetime64[us]", "attempts": "int32"})


def leased_jobs(events: DataFrame, lease_ms: int, late: str = "0 seconds") -> DataFrame:
    """job, at, action, worker, ok, attempts: what events (job, at, action, worker) of jobs come to, and leases that expired.

    add makes a job pending, unless it is under way; claim is ok for a pending or failed job and starts a lease; done and fail
    are ok from the worker that holds the lease. A lease ends with the first event after it or once the watermark passes it.
    """
    _ready(events)
    timed = events.select(F.col("job").cast("string"), F.col("at").cast("timestamp"), "action", F.coalesce("worker", F.lit("")).alias("worker")).withWatermark("at", late)
    out = "job string, at timestamp, action string, worker string, ok boolean, attempts int"
    return timed.groupBy("job").transformWithStateInPandas(Leases(lease_ms), out, "Append", "EventTime")
