"""Channels of a house brought together, and rows anchored, dropped or added."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def drop_issue_rows(readings: DataFrame, issue: str, keys: list[str]) -> DataFrame:
    """Drops every row whose keys (house and timestamp) occur on a row with issue = 1."""
    bad = readings.where(F.col(issue) == 1).select(*keys).distinct()
    return readings.join(bad, keys, "left_anti")


def anchor(df: DataFrame, keys: list[str], ts: str = "ts", weekday: int | None = None) -> DataFrame:
    """Rows from a series' first midnight on; with weekday (Monday 0), from the first midnight of that day.

    A series without such a row is left out.
    """
    at = (F.hour(ts) == 0) & (F.minute(ts) == 0) & (F.second(ts) == 0)
    if weekday is not None:
        at = at & (F.weekday(ts) == weekday)
    first = df.groupBy(*keys).agg(F.min(F.when(at, F.col(ts))).alias("__first"))
    return df.join(first, keys).where(F.col(ts) >= F.col("__first")).drop("__first")


def align_inner(aggregate: DataFrame, channel: DataFrame, keys: list[str]) -> DataFrame:
    """The overlap of two grids. keys: house and bucket."""
    return aggregate.join(channel, keys)


def align_left_zero(aggregate: DataFrame, channel: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """All of the aggregate's buckets; the channel's columns are 0 where it has none."""
    return aggregate.join(channel, keys, "left").fillna(0.0, columns)


def absent_appliances_zero(df: DataFrame, appliances: list[str], keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each listed appliance in every bucket of a house; power and state 0 where there is none."""
    names = F.explode(F.array(*map(F.lit, appliances))).alias("appliance")
    grid = df.select(*keys).distinct().select(*keys, names)
    return grid.join(df, [*keys, "appliance"], "left").fillna(0, columns)


def check_names(names: list[str], allowed: list[str]) -> list[str]:
    """Fails on the driver, before anything runs, for a name that is not in the closed list."""
    unknown = sorted(set(names) - set(allowed))
    if unknown:
        raise ValueError(f"unknown appliances: {', '.join(unknown)}")
    return names


def select_channels(df: DataFrame, appliances: list[str], keys: list[str], x: str = "x", state: str = "status") -> DataFrame:
    """Wide form: keys, then <appliance>_power and <appliance>_state in the order asked for."""
    cells = [F.max(F.when(F.col("appliance") == a, F.col(c))).alias(f"{a}_{n}") for a in appliances for c, n in ((x, "power"), (state, "state"))]
    return df.groupBy(*keys).agg(*cells)
