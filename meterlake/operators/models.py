"""Models as data operators: fitted by MLlib over distributed rows, applied in batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def score_windows(packed: DataFrame, model: Callable, keys: list[str] = ("house",), x: str = "x", s1: float = 0.0, s2: float = 1.0, threshold: float = 0.0) -> DataFrame:
    """keys, win, step, pred: model gets a batch of scaled windows (n, W) and returns as many values; small ones become 0.

    The windows of a batch that have one length go to the model together; keys may be of any type that has a form in Arrow.
    """
    def scored(frames):
        import numpy as np

        for frame in frames:
            for _, own in frame.groupby(frame[x].map(len)) if len(frame) else ():
                made = np.asarray(model((np.stack(own[x].to_numpy()) - s1) / s2)) * s2 + s1
                made = np.where(made < threshold, 0.0, made)
                n, size = made.shape
                repeated = {c: own[c].repeat(size).reset_index(drop=True) for c in [*keys, "win"]}
                yield pd.DataFrame(repeated | {"step": np.tile(np.arange(size), n), "pred": made.ravel()})

    kinds = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in keys)
    return packed.select(*keys, F.col("win").cast("long").alias("win"), x).where(F.size(x) > 0).mapInPandas(scored, f"{kinds}, win long, step long, pred double")


def window_features(windows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Summary features of each window for a regressor: keys, win, mean, std, high, low, first, last."""
    return windows.groupBy(*keys, "win").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max(x).alias("high"), F.min(x).alias("low"), F.min_by(x, "step").alias("first"), F.max_by(x, "step").alias("last"))


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def fit_window_energy(features: DataFrame, columns: list[str], label: str = "energy"):
    """A fitted regressor from window features to window energy; apply with predict()."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="features", labelCol=label, regParam=1e-3).fit(_assembled(features, columns))


def step_features(df: DataFrame, keys: list[str], x: str = "agg", reach: int = 2) -> tuple[DataFrame, list[str]]:
    """Adds the neighbours of each step as features."""
    w = Window.partitionBy(*keys).orderBy("k")
    names = []
    for d in range(-reach, reach + 1):
        name = f"x{'m' if d < 0 else 'p'}{abs(d)}"
        df = df.withColumn(name, F.coalesce(F.lag(x, -d).over(w) if d < 0 else F.lead(x, d).over(w) if d else F.col(x), F.lit(0.0)))
        names.append(name)
    return df, names


def fit_step_power(df: DataFrame, columns: list[str], label: str = "y"):
    """A fitted regressor from step features to appliance power."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="features", labelCol=label, regParam=1e-3).fit(_assembled(df, columns))


def fit_step_state(df: DataFrame, columns: list[str], label: str = "s"):
    """A fitted classifier from step features to on or off."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="features", labelCol=label, regParam=1e-3).fit(_assembled(df, columns))


def predict(model, df: DataFrame, columns: list[str]) -> DataFrame:
    return model.transform(_assembled(df, columns)).drop("features", "rawPrediction", "probability")


def grouped_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One least-squares line per group: keys, n, slope, intercept.

    A line needs only sums, so groups of any size are fitted by partial aggregation and none is
    collected into a task.
    """
    n, sx, sy, sxx, sxy = F.count("*"), F.sum(x), F.sum(y), F.sum(F.col(x) * F.col(x)), F.sum(F.col(x) * F.col(y))
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"))
    bottom = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(bottom != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / bottom)
    return sums.select(*keys, "n", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"))
