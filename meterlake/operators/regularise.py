"""Irregular readings to a regular grid, with bounded gap filling.

Rows are keyed by the columns in `keys` and a bucket number k. Every function over time uses the
same partition and order, so that Spark sorts once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from meterlake.functions.numeric import seconds


def over_time(keys: list[str], k: str = "k") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(k)


def mean(x: Column, digits: int | None = None) -> Column:
    """Mean without missing values; with digits, over fixed-point values, so that the order of rows cannot change it."""
    if digits is None:
        return F.avg(x)
    return F.when(F.count(x) > 0, F.sum(x.cast(f"decimal(18,{digits})")).cast("double") / F.count(x))


def bucket_means(readings: DataFrame, keys: list[str], every: int, ts: str = "ts", value: str = "watts", digits: int | None = None) -> DataFrame:
    """keys, k, x: mean per bucket of `every` seconds, filled buckets only."""
    k = F.floor(seconds(ts, readings.schema[ts].dataType.simpleString()) / every)
    return readings.groupBy(*keys, k.alias("k")).agg(mean(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), digits).alias("x"))


def dense(means: DataFrame, keys: list[str], max_steps: int = 1_000_000_000, block: int = 65_536) -> DataFrame:
    """Every bucket from a key's first to its last one, x NULL where there is none. A longer grid is an error.

    The grid is made block by block, so no row holds more than a block of it.
    """
    ends = means.groupBy(*keys).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    hi = F.when(F.col("hi") - F.col("lo") < max_steps, F.col("hi")).otherwise(F.raise_error(F.lit("the grid of a series is too long")).cast("long"))
    spans = ends.select(*keys, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(hi / block))).alias("__block"))
    first, last = F.col("__block") * block, F.col("__block") * block + block - 1
    grid = spans.select(*keys, F.explode(F.sequence(F.greatest("lo", first), F.least("hi", last))).alias("k"))
    return grid.join(means, [*keys, "k"], "left")


def resample_mean(readings: DataFrame, keys: list[str], every: int, **kw) -> DataFrame:
    return dense(bucket_means(readings, keys, every, **kw), keys)


def run_ids(df: DataFrame, keys: list[str], flag: Column, name: str = "run") -> DataFrame:
    """Adds the number of the run of equal flags that a row is in, for series that one task can order (segments.run_ids: for any)."""
    w = over_time(keys)
    change = F.coalesce((flag != F.lag(flag).over(w)).cast("int"), F.lit(1))
    return df.withColumn(name, F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def fill_long_gaps_zero(df: DataFrame, keys: list[str], longer_than: int = 12, x: str = "x") -> DataFrame:
    """Runs of missing values of more than longer_than steps become 0; shorter ones stay."""
    runs = run_ids(df, keys, F.col(x).isNull(), "__run")
    size = F.count("*").over(Window.partitionBy(*keys, "__run"))
    return runs.withColumn(x, F.when(F.col(x).isNull() & (size > longer_than), 0.0).otherwise(F.col(x))).drop("__run")


def forward_fill(df: DataFrame, keys: list[str], limit: int = 6, x: str = "x") -> DataFrame:
    """The last value fills at most `limit` missing steps after it."""
    return df.withColumn(x, F.last(x, ignorenulls=True).over(over_time(keys).rowsBetween(-limit, 0)))


def downsample(df: DataFrame, keys: list[str], factor: int, columns: list[str]) -> DataFrame:
    """Means of `factor` buckets each, on a dense grid; missing values are left out."""
    every = df.groupBy(*keys, F.floor(F.col("k") / factor).alias("k")).agg(*(F.avg(c).alias(c) for c in columns))
    return dense(every, keys)


def sum_meters(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Sums the meters of a channel per bucket: a missing side counts 0, all missing gives NULL."""
    return df.groupBy(*keys, "k").agg(F.sum(x).alias(x))


def synthetic_aggregate(df: DataFrame, keys: list[str], appliances: list[str], x: str = "x") -> DataFrame:
    """Sum of the listed appliances per bucket, missing values as 0."""
    return df.where(F.col("appliance").isin(appliances)).groupBy(*keys, "k").agg(F.sum(F.coalesce(F.col(x), F.lit(0.0))).alias(x))


def local_time(ts: Column, zone: str = "US/Eastern") -> Column:
    """Wall-clock time of a UTC timestamp; bucket on UTC and show this."""
    return F.from_utc_timestamp(ts, zone)


def in_chunks(df: DataFrame, keys: list[str], size: int, halo: int, rule: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """rule(df, keys) for series too long for one task: pieces of `size` buckets with a halo on both sides.

    The halo must be at least the sum of the reaches of all rules inside: rows in a halo are computed
    for their neighbours and then dropped.
    """
    own = F.floor(F.col("k") / size)
    first, last = F.floor((F.col("k") - halo) / size), F.floor((F.col("k") + halo) / size)
    parts = df.withColumn("__chunk", F.explode(F.sequence(first, last)))
    done = rule(parts, [*keys, "__chunk"])
    return done.where(F.col("__chunk") == own).drop("__chunk")
