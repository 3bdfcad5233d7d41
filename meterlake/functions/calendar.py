"""Calendar features of a timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from meterlake.functions.numeric import col

#: Fixed values: (period of the cycle, smallest and largest value of the linear form).
VARIABLES = {"month": (12, 1, 12), "dom": (31, 1, 31), "dow": (7, 1, 7), "hour": (24, 0, 24), "minute": (60, 0, 60)}


def field(ts: Column | str, variable: str) -> Column:
    """month 1-12, dom 1-31, dow 0-6 from Monday, hour, minute."""
    if variable not in VARIABLES:
        raise ValueError(f"unknown calendar variable {variable!r}")
    return {"month": F.month, "dom": F.dayofmonth, "dow": F.weekday, "hour": F.hour, "minute": F.minute}[variable](col(ts))


def cyclic(ts: Column | str, variables: list[str], shift_ones: bool = False) -> list[Column]:
    """<v>_sin, <v>_cos per variable; shift_ones takes 1 from month, day and weekday first."""
    out = []
    for v in variables:
        x = field(ts, v) - (1 if shift_ones and v in ("month", "dom", "dow") else 0)
        angle = x * (2 * math.pi / VARIABLES[v][0])
        out += [F.sin(angle).alias(f"{v}_sin"), F.cos(angle).alias(f"{v}_cos")]
    return out


def linear(ts: Column | str, variables: list[str], new_range: tuple[float, float] = (-1.0, 1.0)) -> list[Column]:
    """<v> mapped from its range to new_range; weekdays count from 1."""
    return [normalize(field(ts, v) + (1 if v == "dow" else 0), *VARIABLES[v][1:], new_range).alias(v) for v in variables]


def normalize(x: Column | str, low: Column | float, high: Column | float, new_range: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """Min-max to new_range; NULL where low = high."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(high != low, (col(x) - low) / (high - low) * (new_range[1] - new_range[0]) + new_range[0])


def window_timestamps(start: Column | str, every: str, size: int) -> Column:
    """The array of the `size` timestamps of a window that starts at start; every is an interval such as '10 minutes'."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: col(start) + i * F.expr(f"interval {every}"))
