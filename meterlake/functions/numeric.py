"""Column functions on readings. Missing values are NULL; NaN becomes NULL at the door."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: Column | str) -> Column:
    return F.nanvl(col(x), F.lit(None).cast("double"))


def noise_floor(x: Column | str, floor: float = 5.0) -> Column:
    """Values below floor become 0; NULL stays."""
    return F.when(col(x) < floor, 0.0).otherwise(col(x))


def clip(x: Column | str, cutoff: float, low: float = 0.0) -> Column:
    """Values held within [low, cutoff]; NULL stays (least and greatest would drop it)."""
    return F.when(col(x) > cutoff, float(cutoff)).when(col(x) < low, float(low)).otherwise(col(x))


def threshold_status(x: Column | str, low: Column | float, high: Column | float) -> Column:
    """1 where low <= x <= high, else 0; NULL counts as off."""
    return F.coalesce(col(x).between(low, high), F.lit(False)).cast("int")


def restore_missing(status: Column | str, x: Column | str) -> Column:
    """The status, but NULL where the reading is missing."""
    return F.when(col(x).isNotNull(), col(status))


def hard_label(share_on: Column | str) -> Column:
    """After downsampling: on if any part was on."""
    return (col(share_on) > 0).cast("int")


def aggregate_state(x: Column | str) -> Column:
    return (col(x) > 0).cast("int")


def small_to_zero(pred: Column | str, threshold: Column | float) -> Column:
    return F.when(col(pred) < threshold, 0.0).otherwise(col(pred))


def predicted_state(pred: Column | str, threshold: Column | float, activation: Column | float | None = None) -> Column:
    """1 where pred is over the activation threshold, or over the other where there is none."""
    level = threshold if activation is None else F.coalesce(activation if isinstance(activation, Column) else F.lit(activation), threshold if isinstance(threshold, Column) else F.lit(threshold))
    return (col(pred) > level).cast("int")


def cutoff_and_gate(power: Column | str, cutoff: float, threshold: float, floor: float = 5.0) -> tuple[Column, Column]:
    """(power, state): small power to 0, capped, and set to 0 where the state is off."""
    held = F.when(col(power) < floor, 0.0).when(col(power) > cutoff, float(cutoff)).otherwise(col(power))
    state = (held >= threshold).cast("int")
    return held * state, state


def finite_or_zero(x: Column | str) -> Column:
    """NULL, NaN and infinities become 0."""
    return F.when(col(x).isNull() | F.isnan(col(x)) | (F.abs(col(x)) == float("inf")), 0.0).otherwise(col(x))


def middle_quantile(quantiles: Column | str) -> Column:
    """Of several quantile predictions the middle one."""
    q = col(quantiles)
    return F.element_at(q, F.floor(F.size(q) / 2).cast("int") + 1)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero or missing b."""
    return F.when(b != 0, a / b)


def half_even(x: Column | str, digits: int) -> Column:
    return F.bround(col(x), digits)


def seconds(ts: Column | str, kind: str = "timestamp_ntz") -> Column:
    """Whole seconds since 1970; a timestamp_ntz is taken as it stands, whatever the session's zone."""
    if kind == "timestamp_ntz":
        return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), col(ts))
    return F.unix_seconds(col(ts))


def from_seconds(s: Column | str) -> Column:
    return F.timestamp_add("SECOND", col(s), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
