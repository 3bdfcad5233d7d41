"""Scalers: statistics as a one-row (or one row per channel) DataFrame, applied by column math.

s1 and s2 are what is taken off and what is divided by. Statistics are fitted per appliance.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window, functions as F


class Scaling(Enum):
    STANDARD = "standard"  # mean, population standard deviation
    MIN_MAX = "min_max"  # min, max - min
    MEAN = "mean"  # 0, mean
    MEAN_MAX = "mean_max"  # mean, max
    MAX = "max"  # 0, max


def statistics(kind: Scaling, x: Column | str) -> tuple[Column, Column]:
    x = F.col(x) if isinstance(x, str) else x
    return {
        Scaling.STANDARD: (F.avg(x), F.stddev_pop(x)),
        Scaling.MIN_MAX: (F.min(x), F.max(x) - F.min(x)),
        Scaling.MEAN: (F.lit(0.0), F.avg(x)),
        Scaling.MEAN_MAX: (F.avg(x), F.max(x)),
        Scaling.MAX: (F.lit(0.0), F.max(x)),
    }[kind]


def fit(df: DataFrame, kind: Scaling | float, x: str, by: list[str] = ()) -> DataFrame:
    """by..., s1, s2; a number is a constant scale. All rows given count; see fit_on."""
    s1, s2 = statistics(kind, x) if isinstance(kind, Scaling) else (F.lit(0.0), F.lit(float(kind)))
    return df.groupBy(*by).agg(s1.alias("s1"), s2.alias("s2")) if by else df.agg(s1.alias("s1"), s2.alias("s2"))


def fit_on(df: DataFrame, kind: Scaling | float, x: str, by: list[str] = (), split: str = "train") -> DataFrame:
    """fit over the rows of one split only, so that nothing of the others leaks into the scale. df: has split."""
    return fit(df.where(F.col("split") == split), kind, x, by)


def _with(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    # one row; or one row per key, which Spark broadcasts if it is small
    return df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))


def transform(df: DataFrame, stats: DataFrame, x: str, by: list[str] = (), out: str | None = None) -> DataFrame:
    """(x - s1) / s2; NULL where s2 is 0."""
    return _with(df, stats, list(by)).withColumn(out or x, F.when(F.col("s2") != 0, (F.col(x) - F.col("s1")) / F.col("s2"))).drop("s1", "s2")


def inverse(df: DataFrame, stats: DataFrame, x: str, by: list[str] = (), out: str | None = None, steps: int = 1) -> DataFrame:
    """x * s2 + s1; for a sum over `steps` scaled values, their original sum."""
    return _with(df, stats, list(by)).withColumn(out or x, F.col(x) * F.col("s2") + F.col("s1") * steps).drop("s1", "s2")


def temperature(x: Column | str, low: float = 0.0, high: float = 35.0, new_range: tuple[float, float] = (-1.0, 1.0)) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    held = F.when(x < low, low).when(x > high, high).otherwise(x)
    return (held - low) / (high - low) * (new_range[1] - new_range[0]) + new_range[0]


def per_window(df: DataFrame, keys: list[str], x: str, eps: float = 1e-9, out: str = "scaled") -> DataFrame:
    """(x - mean) / (population std + eps) within each window."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, (F.col(x) - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + eps))


def per_window_tokens(df: DataFrame, keys: list[str], x: str, eps: float = 1e-6) -> DataFrame:
    """scaled = (x - mean) / sqrt(population variance + eps), with win_mean and win_std kept."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("win_mean", F.avg(x).over(w)).withColumn("win_std", F.sqrt(F.var_pop(x).over(w) + eps))
    return df.withColumn("scaled", (F.col(x) - F.col("win_mean")) / F.col("win_std"))


def per_channel(df: DataFrame, channel: str, x: str, eps: float = 1e-9, out: str = "scaled") -> DataFrame:
    """z-scores by channel over all rows; the statistics are one row per channel."""
    stats = df.groupBy(channel).agg(F.avg(x).alias("__m"), (F.stddev_pop(x) + eps).alias("__s"))
    return df.join(stats, channel).withColumn(out, (F.col(x) - F.col("__m")) / F.col("__s")).drop("__m", "__s")
