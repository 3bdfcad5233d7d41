"""On/off state from thresholds and run-length rules.

The rules are window expressions over one order: an off gap of at most min_off steps between two on
steps is on; then runs of at least max(min_on, min_activation) steps stay on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.operators import segments
from meterlake.operators.regularise import over_time, run_ids


def merge_short_off(df: DataFrame, keys: list[str], min_off: Column | int, raw: str = "raw", out: str = "status") -> DataFrame:
    """out: raw, and 1 in off gaps of at most min_off steps between on steps."""
    w = over_time(keys)
    on = F.when(F.col(raw) == 1, F.col("k"))
    before = F.max(on).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(on).over(w.rowsBetween(0, Window.unboundedFollowing))
    gap = after - before - 1
    return df.withColumn(out, ((F.col(raw) == 1) | F.coalesce(gap <= min_off, F.lit(False))).cast("int"))


def keep_long_on(df: DataFrame, keys: list[str], min_steps: Column | int, status: str = "status") -> DataFrame:
    """On runs of fewer than min_steps become off. Adds run, the number of the run of equal states."""
    runs = run_ids(df, keys, F.col(status))
    size = F.count("*").over(Window.partitionBy(*keys, "run"))
    return runs.withColumn(status, ((F.col(status) == 1) & (size >= min_steps)).cast("int"))


def status(df: DataFrame, keys: list[str], min_on: int = 1, min_off: int = 0, min_activation: int = 0, raw: str = "raw") -> DataFrame:
    """status 0/1 after all rules, from raw 0/1."""
    return keep_long_on(merge_short_off(df, keys, min_off, raw), keys, max(min_on, min_activation)).drop("run")


def status_by_params(df: DataFrame, params: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """The same with thresholds and durations per appliance from a small dimension (appliance, min_threshold, max_threshold, min_on, min_off, min_activation)."""
    both = df.join(params, "appliance")
    both = both.withColumn("raw", F.coalesce(F.col(x).between(F.col("min_threshold"), F.col("max_threshold")), F.lit(False)).cast("int"))
    merged = merge_short_off(both, keys, F.col("min_off"))
    done = keep_long_on(merged, keys, F.greatest("min_on", "min_activation"))
    return done.drop("run", "min_threshold", "max_threshold", "min_on", "min_off", "min_activation")


def runs_of(df: DataFrame, keys: list[str], state: str = "raw", size: int = segments.SIZE) -> DataFrame:
    """keys, run_start, run_end (exclusive), steps: every contiguous on run; series of any length, by segments of `size` buckets."""
    return segments.runs(df, keys, F.col(state), size=size).withColumnsRenamed({"start": "run_start", "end": "run_end"})


def activations(df: DataFrame, keys: list[str], x: str = "x", state: str = "status", size: int = segments.SIZE) -> DataFrame:
    """keys, start_k, end_k (exclusive), steps, energy per activation; likewise."""
    found = segments.runs(df, keys, F.col(state), {"energy": F.coalesce(F.col(x), F.lit(0.0))}, size)
    return found.withColumnsRenamed({"start": "start_k", "end": "end_k"})
