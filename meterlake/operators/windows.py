"""Count-based windows over regular series. Windows are numbered by position; the start time is the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meterlake.operators import segments

#: Steps of the named window sizes by sampling rate.
NAMED_SIZES = {"day": {"30s": 2880, "1min": 1440, "10min": 144}, "week": {"1min": 10080, "10min": 1008}}


def window_size(size: int | str, rate: str) -> int:
    """Steps of a window: a number, or 'day' or 'week' at a rate for which it is defined."""
    if isinstance(size, int):
        return size
    try:
        return NAMED_SIZES[size][rate]
    except KeyError:
        raise ValueError(f"window size {size!r} is not defined at rate {rate!r}") from None


def positions(df: DataFrame, keys: list[str], k: str = "k") -> DataFrame:
    """Adds pos, the row's number in its series from 0; series may have holes."""
    return segments.positions(df, keys, k)


def range_slice(df: DataFrame, keys: list[str], first: int, last: int, dense: bool = False) -> DataFrame:
    """The rows at places first to last of each series, with pos. dense: the series have no holes."""
    rows = segments.dense_positions(df, keys).drop("__len") if dense else positions(df, keys)
    return rows.where(F.col("pos").between(first, last))


def decimate(df: DataFrame, keys: list[str], points: int = 100, dense: bool = False) -> DataFrame:
    """Every n-th row of each series, n so large that about `points` are left."""
    if dense:
        rows = segments.dense_positions(df, keys)
    else:
        rows = positions(df, keys).join(df.groupBy(*keys).agg(F.count("*").alias("__len")), keys)
    each = F.greatest(F.lit(1), F.floor(F.col("__len") / points))
    return rows.where(F.col("pos") % each == 0).drop("pos", "__len")


def cut(df: DataFrame, keys: list[str], size: int, stride: int | None = None, dense: bool = False) -> DataFrame:
    """Adds win and step; rows of whole windows only. A row is in several windows if stride < size.

    dense: series have every bucket once from their first to their last one, as a regular grid has. Places
    and whole windows then follow from k and the series' length, and nothing is ordered or counted.
    """
    stride = stride or size
    if dense:
        rows = segments.dense_positions(df, keys)
        last = F.floor((F.col("__len") - size) / stride)
        first, own = F.greatest(F.ceil((F.col("pos") - size + 1) / stride), F.lit(0).cast("long")), F.least(F.floor(F.col("pos") / stride), last)
        rows = rows.where(first <= own)
        rows = rows.withColumn("win", own if stride >= size else F.explode(F.sequence(first, own)))
        return rows.withColumn("step", F.col("pos") - F.col("win") * stride).where(F.col("step") < size).drop("pos", "__len")
    rows = positions(df, keys) if "pos" not in df.columns else df
    if stride == size:
        rows = rows.withColumn("win", F.floor(F.col("pos") / size))
    else:
        first = F.greatest(F.ceil((F.col("pos") - size + 1) / stride), F.lit(0).cast("long"))
        last = F.floor(F.col("pos") / stride)
        rows = rows.where(first <= last).withColumn("win", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("step", F.col("pos") - F.col("win") * stride)
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "win"))).where(F.col("__n") == size).drop("__n", "pos")


def drop_gappy(windows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Leaves out windows with a missing value in any of the columns."""
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return windows.withColumn("__gaps", F.sum(missing).over(Window.partitionBy(*keys, "win"))).where("__gaps = 0").drop("__gaps")


def pack(windows: DataFrame, keys: list[str], columns: list[str], k: str = "k") -> DataFrame:
    """One row per window: keys, win, start_k and an array per column, in order of step."""
    arrays = [F.array_sort(F.collect_list(F.struct("step", c))).alias(c) for c in columns]
    packed = windows.groupBy(*keys, "win").agg(F.min(k).alias("start_k"), *arrays)
    for c in columns:
        packed = packed.withColumn(c, F.col(f"{c}.{c}"))
    return packed


def unpack(packed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The long form of packed windows: keys, win, start_k, step and the columns."""
    zipped = F.posexplode(F.arrays_zip(*columns)).alias("step", "__z")
    return packed.select(*keys, "win", "start_k", zipped).select(*keys, "win", "start_k", "step", *(F.col(f"__z.{c}").alias(c) for c in columns))


def energy(windows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """keys, win, energy."""
    return windows.groupBy(*keys, "win").agg(F.sum(x).alias("energy"))


def has_on(windows: DataFrame, keys: list[str], state: str = "status", exactly: bool = False) -> DataFrame:
    """keys, win, label: any state over 0; with exactly, any state equal to 1 (they differ for shares)."""
    on = F.col(state) == 1 if exactly else F.col(state) > 0
    return windows.groupBy(*keys, "win").agg(F.max(on.cast("int")).alias("label"))


def basis_projection(df: DataFrame, keys: list[str], basis: list[list[float]], x: str = "x") -> DataFrame:
    """b0, b1, ...: dot products of the next K values (0 beyond the end) with each basis vector of length K."""
    w = Window.partitionBy(*keys).orderBy("k")
    ahead = [F.coalesce(F.lead(x, i).over(w) if i else F.col(x), F.lit(0.0)) for i in range(len(basis[0]))]
    return df.select("*", *(sum((float(b) * a for b, a in zip(vector, ahead, strict=True)), F.lit(0.0)).alias(f"b{j}") for j, vector in enumerate(basis)))
