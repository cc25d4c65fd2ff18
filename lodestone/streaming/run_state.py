"""Run status as keyed state that ends: value state and timers on event time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import runs

OPEN = ("queued", "running")  # states that a run can still leave


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams may use value state and timers; the caller's session stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


class LastStatus(StatefulProcessor):
    """The newest snapshot's time and status of each run. A finished run leaves ``settled`` after its last snapshot, any other ``silent`` after its."""

    def __init__(self, settled: dt.timedelta, silent: dt.timedelta) -> None:
        self.ms = {True: int(settled.total_seconds() * 1000), False: int(silent.total_seconds() * 1000)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = new = tuple(self.last.get()) if self.last.exists() else None
        for b in rows:
            for at, seq, status in zip(b["at"].tolist(), b["seq"].tolist(), b["status"].tolist()):
                if new is None or (at, seq) > new[:2]:
                    new = (at, seq, status)
        if new == old:
            return
        self.last.update(new)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = new[0] // 1000 + self.ms[new[2] not in OPEN]
        self.handle.registerTimer(max(ends, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"run_id": [key[0]], "at": [new[0]], "status": [new[2]]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_status(snapshots: DataFrame, late: str = "1 day", settled: dt.timedelta = dt.timedelta(days=1), silent: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """(run_id, at, status) of runs whose newest snapshot has changed; update mode, on a session of `stream_session`.

    snapshots(run_id long, ts timestamp, seq long, node_runs and flags); of equal times the greater seq is newer. A snapshot older than the run's newest changes
    nothing. A run is forgotten once the watermark has passed its last snapshot by ``settled`` or ``silent``; what could
    still revive it by then is older than the watermark, so it is dropped as late.
    """
    x = runs.with_status(snapshots.withWatermark("ts", late)).select("run_id", "ts", F.unix_micros("ts").alias("at"), "seq", "status")
    return x.groupBy("run_id").transformWithStateInPandas(LastStatus(settled, silent), "run_id long, at long, status string", "Update", "EventTime")
