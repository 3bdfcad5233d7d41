"""The first steps of the batch pipeline on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def bucket_means(stream: DataFrame, keys: list[str], every: str = "10 seconds", late: str = "1 minute", ts: str = "ts", value: str = "watts") -> DataFrame:
    """keys, start, x: event-time bucket means; rows later than `late` are dropped."""
    grouped = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, every))
    return grouped.agg(F.avg(value).alias("x")).select(*keys, F.col("window.start").alias("start"), "x")


def on_sessions(stream: DataFrame, keys: list[str], gap: str, low: float, high: float, late: str = "1 minute", ts: str = "ts", value: str = "watts") -> DataFrame:
    """keys, start, end, readings, energy: on readings no further apart than gap are one session."""
    on = stream.where(F.col(value).between(low, high)).withWatermark(ts, late)
    grouped = on.groupBy(*keys, F.session_window(ts, gap))
    return grouped.agg(F.count("*").alias("readings"), F.sum(value).alias("energy")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "readings", "energy")


def last_values(stream: DataFrame, key: str, limit_s: int, ts: str = "ts", value: str = "watts") -> DataFrame:
    """key, ts, watts, gap_s: each reading with its distance to the one before, NULL beyond limit_s; state is one timestamp per key."""

    def step(key_value: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values(ts)
            seconds = frame[ts].astype("int64") // 1_000_000_000 if str(frame[ts].dtype).startswith("datetime64[ns") else frame[ts].astype("datetime64[s]").astype("int64")
            gaps = []
            for s in seconds:
                gap = None if before is None else float(s - before)
                gaps.append(gap if gap is not None and gap <= limit_s else None)
                before = max(int(s), before or int(s))
            yield pd.DataFrame({key: key_value[0], "ts": frame[ts], "watts": frame[value], "gap_s": gaps})
        if before is not None:
            state.update((before,))

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, watts double, gap_s double", "last long", "append", "NoTimeout")
