"""Structured Streaming: the telemetry windows over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Calls in each window; windows close `late` after the latest event seen."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "key").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "key", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls in each session of a key."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("n")).select("w.start", "w.end", "key", "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def anomalies(events: DataFrame, least: int = 5, limit: float = 2.5, minutes: int = 60) -> DataFrame:
    """(key, ts, value, z): values that deviate by more than `limit` sample deviations from the key's last hour, themselves included.

    The state holds the values of the last `minutes` (times in microseconds) and goes when a key has been silent that long."""
    width = minutes * 60 * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, values = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        new = pd.concat(list(batches)).sort_values("ts", kind="stable")
        before = len(times)
        times = np.concatenate([times, new["ts"].astype("datetime64[us]").astype(np.int64).to_numpy()])
        values = np.concatenate([values, new["value"].to_numpy(float)])
        order = np.argsort(times, kind="stable")
        fresh = order >= before
        times, values = times[order], values[order]
        first = np.searchsorted(times, times - width, side="right")
        n = np.arange(1, len(times) + 1) - first
        centred = values - values.mean()
        sums, squares = (np.append(0.0, np.cumsum(x)) for x in (centred, centred**2))
        total, square = sums[1:] - sums[first], squares[1:] - squares[first]
        sd = np.sqrt(np.maximum(square - total**2 / n, 0) / np.maximum(n - 1, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (centred - total / n) / sd
        out = fresh & (n >= least) & (sd > 1e-12) & (np.abs(z) > limit)
        keep = times > times[-1] - width
        state.update((times[keep].tolist(), values[keep].tolist()))
        state.setTimeoutTimestamp(max(int(times[-1] + width) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "ts": pd.to_datetime(times[out], unit="us", utc=True), "value": values[out], "z": z[out]})

    watched = events.withWatermark("ts", f"{minutes} minutes")
    return watched.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, value double, z double", "times array<long>, vals array<double>", "append", GroupStateTimeout.EventTimeTimeout)
