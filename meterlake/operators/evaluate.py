"""Metrics per step, per window and per period, and those that need an order by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.functions import metrics as M
from meterlake.functions.numeric import ratio
from meterlake.operators.ordered import running_sums, value_ranges


def per_step(df: DataFrame, by: list[str] = (), digits: int | None = 3, both: bool = False) -> DataFrame:
    """All metrics over steps. df: y, p, s (true state), q (predicted state). both: as in metrics.states."""
    cols = M.bundle(M.regression() | M.energy() | M.states(both=both), digits)
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def per_window(df: DataFrame, keys: list[str], by: list[str] = (), digits: int | None = 3) -> DataFrame:
    """Error and energy metrics over window sums."""
    sums = df.groupBy(*keys).agg(F.sum("y").alias("y"), F.sum("p").alias("p"))
    cols = M.bundle(M.regression() | M.energy(), digits)
    return sums.groupBy(*by).agg(*cols) if by else sums.agg(*cols)


def period_sums(df: DataFrame, keys: list[str], period: str, ts: str = "ts", columns: list[str] = ("y", "p", "total")) -> DataFrame:
    """keys, period and 1 + the sum of each column, for every day, week or month from a key's first to its last one."""
    sums = df.groupBy(*keys, F.date_trunc(period, ts).cast("date").alias("period")).agg(*(F.sum(c).alias(c) for c in columns))
    ends = sums.groupBy(*keys).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    grid = ends.select(*keys, F.explode(F.expr(f"sequence(lo, hi, interval 1 {period})")).alias("period"))
    full = grid.join(sums, [*keys, "period"], "left")
    return full.select(*keys, "period", *((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + 1).alias(c) for c in columns))


def by_period(df: DataFrame, keys: list[str], period: str, digits: int | None = 3) -> DataFrame:
    """Error and energy metrics over all period sums (each with 1 added, so that no bin is empty)."""
    return period_sums(df, keys, period).agg(*M.bundle(M.regression() | M.energy(), digits))


def share_of_total(df: DataFrame, keys: list[str], period: str, digits: int | None = 3) -> DataFrame:
    """The same over the shares of the total, in percent, and the mean true share."""
    shares = period_sums(df, keys, period).select((F.col("y") / F.col("total")).alias("y"), (F.col("p") / F.col("total")).alias("p"))
    parts = {k: c * 100 for k, c in (M.regression() | M.energy()).items()} | {"true_ratio": F.avg("y") * 100}
    return shares.agg(*M.bundle(parts, digits))


def log_norm_error(df: DataFrame, keys: list[str], least: float = 1e-20) -> DataFrame:
    """Mean over windows of the log of the mean absolute error."""
    one = df.groupBy(*keys).agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("e"))
    return one.agg(F.avg(F.log(F.greatest("e", F.lit(least)))).alias("log_norm"))


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, pos, neg per distinct score: what the ranked metrics need, pre-aggregated."""
    return df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rank statistic, ties count half."""
    each = value_ranges(_by_score(df, score, label), score)
    ranked = running_sums(each, F.col("value_range"), [score], {"below": F.col("neg")})
    wins = ranked.select("pos", "neg", (F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"))
    return wins.agg(ratio(F.sum("wins"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum of the steps in recall times the precision there, over distinct scores from the highest on."""
    each = value_ranges(_by_score(df, score, label), score, descending=True)
    ranked = running_sums(each, F.col("value_range"), [F.desc(score)], {"tp": F.col("pos"), "n": F.col("pos") + F.col("neg")})
    seen = ranked.select("pos", (F.col("tp") + F.col("pos")).alias("tp"), (F.col("n") + F.col("pos") + F.col("neg")).alias("n"))
    return seen.agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("n")), F.sum("pos").cast("double")).alias("ap"))


def split_stats(df: DataFrame, by: list[str], on: Column) -> DataFrame:
    """by..., n, n_on, pct_on and pct_total."""
    one = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(on).alias("n_on"))
    return one.select("*", (F.col("n_on") * 100 / F.col("n")).alias("pct_on"), (F.col("n") * 100 / F.sum("n").over(Window.partitionBy())).alias("pct_total"))


def rolled_up(df: DataFrame, levels: list[str], metrics: dict[str, Column], digits: int = 3) -> DataFrame:
    """Metric tables by all prefixes of levels, NULL standing for all."""
    return df.rollup(*levels).agg(*M.bundle(metrics, digits))
