"""The whole preparation of a dataset, one order of steps per layout of the source.

The order matters: where filling stands against summing meters, and downsampling against the
synthetic aggregate, differs between the layouts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from meterlake.functions import numeric as N
from meterlake.operators import align as J, regularise as R, status as S
from meterlake.sources import known

CHANNEL = ["house", "appliance"]


@dataclass(frozen=True)
class Rules:
    """On between low and high; durations in steps of the fine grid."""

    low: float
    high: float
    min_on: int = 1
    min_off: int = 0
    min_activation: int = 0


@dataclass(frozen=True)
class Profile:
    """Steps in seconds and grid steps; layout is 'channels', 'wide' or 'meters'."""

    layout: str
    rules: dict[str, Rules]
    every: int = 10
    fill: int = 6
    long_gap: int | None = 12
    cutoff: float = 6000.0
    floor: float = 5.0
    factor: int = 6
    use_durations: bool = True
    soft_label: bool = False
    synthetic: list[str] = field(default_factory=list)
    anchor: str | None = None  # 'day' or 'week': mains start at a first midnight, or a first one of that weekday
    weekday: int = 1
    chunk: int = 65_536  # buckets of a series that one task takes, with what the rules reach over on both sides


#: Layout and steps of the three public datasets that sources.known describes.
KNOWN = {
    "ukdale": {"layout": "channels", "every": 10, "fill": 6, "long_gap": 12, "cutoff": 6000.0, "floor": 5.0, "factor": 6},
    "refit": {"layout": "wide", "every": 10, "fill": 9, "long_gap": None, "cutoff": 10_000.0, "floor": 5.0, "factor": 6},
    "redd": {"layout": "meters", "every": 10, "fill": 6, "long_gap": 12, "cutoff": 6000.0, "floor": 5.0, "factor": 6},
}


def known_profile(dataset: str, durations: bool = True, synthetic: bool = False, **changes) -> Profile:
    """The preparation of a known dataset: its layout, steps and rules, with durations or by thresholds alone; changes replace fields."""
    if durations:
        rules = {a: Rules(float(low), float(high), *rest) for a, (low, high, *rest) in known.DURATION_RULES[dataset].items()}
    else:
        rules = {a: Rules(float(low), float(high)) for a, (low, high) in known.PLAIN_RULES[dataset].items()}
    own = {"rules": rules, "use_durations": durations, "synthetic": known.SYNTHETIC[dataset] if synthetic else []}
    return Profile(**(KNOWN[dataset] | own | changes))


def prepare(readings: DataFrame, profile: Profile, mains: str = "aggregate") -> DataFrame:
    """house, appliance, k (coarse grid), x, status, total.

    readings: house, appliance (mains under its own name), ts, watts; with a meter column for the
    layout 'meters'; with an issue column for 'wide'. Channels of the synthetic aggregate without
    rules count in it, and have no rows of their own. Rules over time run on pieces of a series, so
    that a long one is no single task.
    """
    p = profile
    if p.layout == "wide":
        readings = J.drop_issue_rows(readings, "issue", ["house", "ts"])
    keys = [*CHANNEL, "meter"] if p.layout == "meters" else CHANNEL
    series = R.resample_mean(readings, keys, p.every)
    main, channel = series.where(F.col("appliance") == mains), series.where(F.col("appliance") != mains)
    long_gap = p.long_gap if p.layout != "wide" else None
    fill = lambda df, by: R.in_chunks(df, by, p.chunk, p.fill + 1, lambda d, w: R.forward_fill(d, w, p.fill))
    main = fill(main, keys)
    if p.layout == "meters":
        main = R.sum_meters(main, CHANNEL)
        channel = R.sum_meters(channel, CHANNEL)
    if long_gap is None:
        channel = fill(channel, CHANNEL)
    else:
        zeros = lambda d, w: R.forward_fill(R.fill_long_gaps_zero(d, w, long_gap), w, p.fill)
        channel = R.in_chunks(channel, CHANNEL, p.chunk, long_gap + p.fill + 2, zeros)
    clean = lambda x: N.clip(N.noise_floor(x, p.floor), p.cutoff)
    main = main.select("house", "k", clean("x").alias("total"))
    if p.anchor:
        main = J.anchor(main.withColumn("ts", N.from_seconds(F.col("k") * p.every)), ["house"], weekday=p.weekday if p.anchor == "week" else None).drop("ts")
    both = J.align_inner(main, channel.select(*CHANNEL, "k", clean("x").alias("x")), ["house", "k"])
    named = both.where(F.col("appliance").isin(list(p.rules)))
    low = F.create_map(*(F.lit(v) for a, r in p.rules.items() for v in (a, float(r.low))))[F.col("appliance")]
    high = F.create_map(*(F.lit(v) for a, r in p.rules.items() for v in (a, float(r.high))))[F.col("appliance")]
    state = named.withColumn("raw", N.threshold_status("x", low, high))
    if p.use_durations:
        of = lambda get: F.create_map(*(F.lit(v) for a, r in p.rules.items() for v in (a, get(r))))[F.col("appliance")]
        durations = lambda d, w: S.keep_long_on(S.merge_short_off(d, w, of(lambda r: r.min_off)), w, of(lambda r: max(r.min_on, r.min_activation))).drop("run")
        # runs are counted in rows, and a gap or a run may begin where the other ends
        reach = max((r.min_off + max(r.min_on, r.min_activation) for r in p.rules.values()), default=0) + 2
        state = R.in_chunks(state, CHANNEL, p.chunk, reach, durations)
    else:
        state = state.withColumn("status", F.col("raw"))
    state = state.withColumn("status", N.restore_missing("status", "x"))
    coarse = R.downsample(state, CHANNEL, p.factor, ["x", "status", "total"])
    if not p.soft_label:
        coarse = coarse.withColumn("status", N.hard_label("status"))
    if p.synthetic:
        more = channel.where(F.col("appliance").isin([a for a in p.synthetic if a not in p.rules]))
        more = R.downsample(more.select(*CHANNEL, "k", clean("x").alias("x")), CHANNEL, p.factor, ["x"])
        parts = coarse.select(*CHANNEL, "k", "x").unionByName(more.select(*CHANNEL, "k", "x"))
        made = R.synthetic_aggregate(parts, ["house"], p.synthetic).withColumnRenamed("x", "total")
        coarse = coarse.drop("total").join(made, ["house", "k"], "left")
    return coarse.select(*CHANNEL, "k", "x", "status", "total")
