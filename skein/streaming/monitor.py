"""Web metrics by label from a stream of events: two gauges, four totals and the exact median and 95th percentile of recent lags.

Each label keeps, as arbitrary state, its totals, the events that the watermark hasn't passed yet, in parts by slices of time, and the
lags of the trailing window, pruned at every flush. What is due is read one slice after the other, so a task holds a slice and
a buffer of new events, however many a label has. A flush is due at the end of each interval that has an event; it happens when the watermark
passes it and gives one row for each of the eight series. Events may come in any order within the watermark's delay, so the rows
depend on the events alone, not on batches or restarts.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The series, seconds of the trailing window and between flushes.
GAUGES = ("ws_connected", "sse_connected")
TOTALS = ("events_pushed_total", "events_dropped_total", "ai_requests_total", "ai_errors_total")
LAGS = ("event_lag_ms_p50", "event_lag_ms_p95")
SERIES = (*GAUGES, *TOTALS, *LAGS)
WINDOW_SECONDS, FLUSH_SECONDS = 120, 10
KINDS = ("ws_open", "ws_close", "sse_open", "sse_close", "pushed", "dropped", "ai_request", "ai_error")
# What an event of each kind adds to the gauges and totals.
ADDS = np.array(
    [[1, 0, 0, 0, 0, 0], [-1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0], [0, -1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0], [0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 1, 1]], np.int64
)
RESULT = "at timestamp, series string, labels_json string, value double"
EVENT = np.dtype([("at", np.int64), ("id", np.int64), ("kind", np.uint8), ("count", np.int64), ("lag", np.float64)])
STATE = "level array<bigint>, first bigint, slice array<bigint>, parts array<int>, sample_at binary, sample_lag binary"
# Microseconds of a slice of pending events, and new events that are put away at once.
SLICE, BUFFER = 3600 * 1_000_000, 1_000_000


def percentile(ordered: np.ndarray, p: float) -> float:
    """The linearly interpolated percentile of sorted values, 0 without any."""
    if not len(ordered):
        return 0.0
    k = (len(ordered) - 1) * (p / 100.0)
    low = int(k)
    high = min(low + 1, len(ordered) - 1)
    return float(ordered[low] if low == high else ordered[low] * (high - k) + ordered[high] * (k - low))


def flushed(level: np.ndarray, events: np.ndarray, samples: tuple[np.ndarray, np.ndarray], window: int, interval: int) -> tuple:
    """(level, samples, times, eight values for each) after sorted events, all of whose flushes are due; times in microseconds."""
    adds = ADDS[events["kind"]] * events["count"][:, None]
    adds[:, : len(GAUGES)] = ADDS[events["kind"], : len(GAUGES)]
    sums = level + np.cumsum(adds, axis=0)
    # a gauge never falls below zero: a close without an open counts for nothing
    sums[:, : len(GAUGES)] -= np.minimum(0, np.minimum.accumulate(sums[:, : len(GAUGES)], axis=0))
    lagging = ~np.isnan(events["lag"])
    at, lag = np.r_[samples[0], events["at"][lagging]], np.r_[samples[1], events["lag"][lagging]]
    due = -(-events["at"] // interval) * interval
    last = np.r_[np.flatnonzero(np.diff(due)), len(due) - 1]
    first, end = np.searchsorted(at, due[last] - window, "left"), np.searchsorted(at, due[last], "right")
    values = np.empty((len(last), len(SERIES)))
    values[:, : len(SERIES) - len(LAGS)] = sums[last]
    for k, (a, b) in enumerate(zip(first.tolist(), end.tolist())):
        ordered = np.sort(lag[a:b])
        values[k, -2:] = percentile(ordered, 50.0), percentile(ordered, 95.0)
    return sums[-1], (at[first[-1] :], lag[first[-1] :]), due[last], values


def buffered(frames: Iterator[pd.DataFrame], size: int = BUFFER) -> Iterator[np.ndarray]:
    """The frames' events as arrays of ``EVENT``, of about ``size`` each."""
    held, n = [], 0
    for f in frames:
        rows = np.empty(len(f), EVENT)
        for c in EVENT.names:
            rows[c] = f[c].to_numpy()
        held.append(rows)
        n += len(rows)
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


class Monitor(StatefulProcessor):
    """The state of one label."""

    def __init__(self, window: int, interval: int):
        self.window, self.interval = window, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("label", STATE)
        self.pending = handle.getMapState("pending", "slice bigint, part int", "events binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, iter(()), timerValues.getCurrentWatermarkInMs())

    def advance(self, key: Any, frames: Iterator[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        level = np.array(held[0], np.int64) if held else np.zeros(len(GAUGES) + len(TOTALS), np.int64)
        first, parts = (held[1], dict(zip(held[2], held[3]))) if held else (None, {})
        samples = (np.frombuffer(held[4], np.int64), np.frombuffer(held[5], np.float64)) if held else (np.zeros(0, np.int64), np.zeros(0))
        for rows in buffered(frames):
            due = self.due(rows)
            first = int(due.min()) if first is None else min(first, int(due.min()))
            slices = due // SLICE
            order = np.argsort(slices, kind="stable")
            of, begins = np.unique(slices[order], return_index=True)
            for at, some in zip(of.tolist(), np.split(rows[order], begins[1:])):
                self.put(at, parts, some)
        passed = watermark * 1000
        while first is not None and first <= passed:
            at = min(parts)
            rows = np.concatenate([np.frombuffer(self.pending.getValue((at, k))[0], EVENT) for k in range(parts[at])])
            for k in range(parts.pop(at)):
                self.pending.removeKey((at, k))
            rows = rows[np.lexsort([rows["id"], rows["at"]])]
            due = self.due(rows)
            n = int(np.searchsorted(due, passed, "right"))
            if n:
                level, samples, times, values = flushed(level, rows[:n], samples, self.window, self.interval)
                when = pd.to_datetime(np.repeat(times, len(SERIES)), unit="us", utc=True)
                yield pd.DataFrame({"at": when, "series": SERIES * len(times), "labels_json": key[0], "value": values.ravel()})
            if n < len(rows):
                self.put(at, parts, rows[n:])
                first = int(due[n])
            else:
                # where the next slice begins: no event of it is due before
                first = min(parts) * SLICE if parts else None
        self.state.update((level.tolist(), first, list(parts), list(parts.values()), samples[0].tobytes(), samples[1].tobytes()))
        if first is not None:
            self.handle.registerTimer(first // 1000)

    def due(self, rows: np.ndarray) -> np.ndarray:
        return -(-rows["at"] // self.interval) * self.interval

    def put(self, at: int, parts: dict[int, int], rows: np.ndarray) -> None:
        """Puts rows of the slice ``at`` away as its next part."""
        self.pending.updateValue((at, parts.get(at, 0)), (rows.tobytes(),))
        parts[at] = parts.get(at, 0) + 1


def web_metrics(events: DataFrame, late: str = "10 minutes", window: int = WINDOW_SECONDS, interval: int = FLUSH_SECONDS) -> DataFrame:
    """(at, series, labels_json, value) of a stream (labels_json, id, ts, kind, count, lag_ms).

    Kinds are those of ``KINDS``; an ``ai_error`` is a request that failed. count is how often it happened (null: once, below zero: never), lag_ms is
    taken from deliveries, below zero as zero, null as none. Rows without a label or time, and of other kinds, are left out; rows later
    than ``late`` are dropped by the watermark. A label's rows pass through one task, which holds a slice of them, and are kept no longer than the window or the delay.
    The session needs the RocksDB state store (see ``state_store``).
    """
    known = events.where(F.col("kind").isin(*KINDS) & F.col("labels_json").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    lag = F.when(F.col("kind") == "pushed", F.greatest(F.lit(0.0), F.col("lag_ms")))
    count = F.greatest(F.lit(0), F.coalesce("count", F.lit(1))).cast("long")
    rows = known.select("labels_json", "ts", F.unix_micros("ts").alias("at"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), kind.cast("int").alias("kind"), count.alias("count"), F.when(F.col("lag_ms").isNotNull(), lag).alias("lag"))
    return rows.groupBy("labels_json").transformWithStateInPandas(Monitor(window * 1_000_000, interval * 1_000_000), outputStructType=RESULT, outputMode="append", timeMode="eventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that arbitrary state needs, for the queries that start within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def recent(metrics: DataFrame, now, seconds: int = 60) -> DataFrame:
    """The largest value of each series in the last ``seconds`` before ``now`` (a timestamp column)."""
    return metrics.where(F.col("at") >= now - F.make_dt_interval(secs=F.lit(float(seconds)))).groupBy("series").agg(F.max("value").alias("value"))
