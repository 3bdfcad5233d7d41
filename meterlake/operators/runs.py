"""Experiment runs: grids, what is left to do, loss curves, stopping rules and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def grid(*dimensions: DataFrame) -> DataFrame:
    """Every combination of small dimensions (appliances, window sizes, models, seeds)."""
    return reduce(lambda a, b: a.crossJoin(b), dimensions)


def pending(planned: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(finished.select(*keys).distinct(), keys, "left_anti")


def progress(planned: DataFrame, finished: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """by..., done, total."""
    marked = planned.join(finished.select(*keys).distinct().withColumn("__done", F.lit(True)), keys, "left")
    cols = F.count("__done").alias("done"), F.count("*").alias("total")
    return marked.groupBy(*by).agg(*cols) if by else marked.agg(*cols)


def loss_curves(runs: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """keys, epoch, loss, split from array columns; columns: split name by array column."""
    parts = [runs.select(*keys, F.posexplode(c).alias("epoch", "loss"), F.lit(name).alias("split")) for c, name in columns.items()]
    return reduce(DataFrame.unionByName, parts)


def best_epoch(curves: DataFrame, keys: list[str], warm_up: int = 0) -> DataFrame:
    """keys, epoch, loss: the smallest loss after the warm-up, the latest epoch on ties."""
    later = curves.where(F.col("epoch") >= warm_up)
    return later.groupBy(*keys).agg(F.min(F.struct("loss", (-F.col("epoch")).alias("late"))).alias("b")).select(*keys, (-F.col("b.late")).alias("epoch"), F.col("b.loss").alias("loss"))


def early_stop(curves: DataFrame, keys: list[str], patience: int, min_delta: float = 0.0, warm_up: int = -1) -> DataFrame:
    """keys, epoch: where training stops, NULL if it doesn't.

    A loss over the smallest so far by more than min_delta counts; a new smallest loss resets the
    count, an equal one leaves it. Epochs up to warm_up are not looked at.
    """
    seen = curves.where(F.col("epoch") > warm_up)
    w = Window.partitionBy(*keys).orderBy("epoch")
    low = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = seen.withColumn("__low", low).withColumn("__new", F.coalesce(F.col("loss") < F.col("__low"), F.lit(True)).cast("int"))
    marked = marked.withColumn("__worse", F.coalesce(F.col("loss") > F.col("__low") + min_delta, F.lit(False)).cast("int"))
    marked = marked.withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.sum("__worse").over(Window.partitionBy(*keys, "__group").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__count", count).groupBy(*keys).agg(F.min(F.when(F.col("__count") >= patience, F.col("epoch"))).alias("epoch"))


def fold_average(runs: DataFrame, by: list[str], metrics: list[str], digits: int = 3) -> DataFrame:
    """Means over seeds, rounded half to even."""
    return runs.groupBy(*by).agg(*(F.bround(F.avg(m), digits).alias(m) for m in metrics))


def parse_names(runs: DataFrame, name: str) -> DataFrame:
    """Adds model and suffix from names such as model_128 or model_30s; both NULL where the name does not match."""
    pattern = r"^(.+)_(\d+\w*)$"
    hit = F.col(name).rlike(pattern)
    return runs.withColumn("model", F.when(hit, F.regexp_extract(name, pattern, 1))).withColumn("suffix", F.when(hit, F.regexp_extract(name, pattern, 2)))


def ordered_windows(windows: DataFrame, mode: str = "file", on: str = "on", index: str = "idx") -> DataFrame:
    """File order, on windows first, or on windows only."""
    if mode == "file":
        return windows.orderBy(index)
    if mode == "on_first":
        return windows.orderBy(F.desc(on), index)
    if mode == "on_only":
        return windows.where(F.col(on) == 1).orderBy(index)
    raise ValueError(f"unknown order {mode!r}")
