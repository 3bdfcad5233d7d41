"""Metric bundles as aggregate columns: use them in any groupBy(...).agg(*...)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meterlake.functions.numeric import col, finite_or_zero, ratio


def regression(y: Column | str = "y", p: Column | str = "p") -> dict[str, Column]:
    """mae, mse, rmse."""
    y, p = finite_or_zero(y), finite_or_zero(p)
    mse = F.avg((p - y) * (p - y))
    return {"mae": F.avg(F.abs(p - y)), "mse": mse, "rmse": F.sqrt(mse)}


def energy(y: Column | str = "y", p: Column | str = "p") -> dict[str, Column]:
    """teca, nde, sae, mr; NULL where the truth has no energy."""
    y, p = finite_or_zero(y), finite_or_zero(p)
    err = p - y
    return {
        "teca": 1 - ratio(F.sum(F.abs(err)), 2 * F.sum(F.abs(y))),
        "nde": ratio(F.sum(err * err), F.sum(y * y)),
        "sae": ratio(F.abs(F.sum(p) - F.sum(y)), F.sum(y)),
        "mr": ratio(F.sum(F.least(p, y)), F.sum(F.greatest(p, y))),
    }


def counts(s: Column | str, q: Column | str) -> tuple[Column, Column, Column, Column]:
    """True and false positives, false and true negatives of states 0 and 1."""
    s, q = col(s), col(q)
    return F.count_if((s == 1) & (q == 1)), F.count_if((s == 0) & (q == 1)), F.count_if((s == 1) & (q == 0)), F.count_if((s == 0) & (q == 0))


def share(a: Column, b: Column) -> Column:
    """a / b, and 0 where it is undefined."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def states(s: Column | str = "s", q: Column | str = "q", both: bool = False) -> dict[str, Column]:
    """accuracy, balanced_accuracy, precision, recall, f1, f1_macro.

    A class that occurs neither in truth nor in prediction has no part in the macro mean; with both, it counts 0 there.
    """
    tp, fp, fn, tn = counts(s, q)
    on, off = ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1, f0 = share(2 * tp, 2 * tp + fp + fn), share(2 * tn, 2 * tn + fn + fp)
    mean = (f1 + f0) / 2
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": F.when(on.isNull(), off).when(off.isNull(), on).otherwise((on + off) / 2),
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": f1,
        "f1_macro": mean if both else F.when(tp + fp + fn == 0, f0).when(tn + fp + fn == 0, f1).otherwise(mean),
    }


def mape(y: Column | str, p: Column | str, eps: float = 2.220446049250313e-16) -> Column:
    return F.avg(F.abs(col(p) - col(y)) / F.greatest(F.abs(col(y)), F.lit(eps)))


def pinball(y: Column | str, p: Column | str, q: float) -> Column:
    e = col(y) - col(p)
    return F.avg(F.greatest(q * e, (q - 1) * e))


def bundle(parts: dict[str, Column], digits: int | None = 3) -> list[Column]:
    """The columns of a bundle under their names, rounded half to even."""
    return [(c if digits is None else F.bround(c.cast("double"), digits)).alias(k) for k, c in parts.items()]
