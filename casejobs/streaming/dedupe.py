"""Deduplication of tasks in flight, with keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

_STORE = "spark.sql.streaming.stateStore.providerClass"
_KEPT_IN_FILES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstTask(StatefulProcessor):
    """Lets the first task of a case pass, by time and address, and remembers the case until its timer comes."""

    def __init__(self, bound_ms: int):
        self.bound_ms = bound_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "until bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:  # a hot case comes in several pieces
            both = part if best is None else pd.concat([best, part])
            best = both.sort_values(["enqueued_at", "source_url"], kind="stable").head(1)
        if best is None or self.passed.exists():
            return
        until = int(best["enqueued_at"].iloc[0].timestamp() * 1000) + self.bound_ms
        self.passed.update((until,))
        self.handle.registerTimer(max(until, timerValues.getCurrentWatermarkInMs() + 1))
        yield best[["source_url", "case_id", "enqueued_at"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.passed.clear()
        yield from ()

    def close(self) -> None:
        pass


def dedupe_stream(tasks: DataFrame, bound: str = "1 hour") -> DataFrame:
    """The tasks (source_url, case_id, enqueued_at) that come first: a case_id passes once within the bound.

    Of the tasks of a batch the first by (enqueued_at, source_url) passes. What comes for the same case later, up to the
    bound after it by the tasks' own time, is dropped; then the case is forgotten, so state is kept for the bound
    only. Tasks that are late by more than the bound, or without a case_id or a time, are dropped. Needs state kept in
    RocksDB, and sets the session so.
    """
    spark = tasks.sparkSession
    spark.conf.set(_STORE, _KEPT_IN_FILES)
    bound_ms = spark.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {bound}"))).alias("ms")).first()[0]
    timed = tasks.where("case_id IS NOT NULL AND enqueued_at IS NOT NULL").select("source_url", F.col("case_id").cast("string").alias("case_id"), F.col("enqueued_at").cast("timestamp").alias("enqueued_at"))
    grouped = timed.withWatermark("enqueued_at", bound).groupBy("case_id")
    return grouped.transformWithStateInPandas(_FirstTask(bound_ms), "source_url string, case_id string, enqueued_at timestamp", "append", "EventTime")
