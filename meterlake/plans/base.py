"""Readings made from the given tables, and the SQL of the same steps, shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlake.functions import numeric as N
from meterlake.operators import regularise as R, status as S, windows as W

HOUR = 3600
KEYS = ["house", "appliance"]
#: Rules used by the queries: on between 40 and 300, gaps of 2 merged, runs of 2 kept, windows of a day of hours.
LOW, HIGH, MIN_OFF, MIN_ON, MIN_ACTIVATION, SIZE = 40.0, 300.0, 2, 2, 1, 24

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as meter readings: house = user_id % 4, appliance = event_type."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("house"), F.col("event_type").alias("appliance"), "ts", F.col("value").alias("watts"), "event_id", "user_id")


def grid(spark: SparkSession, sf_dir: str, every: int = HOUR, keys: list[str] = KEYS) -> DataFrame:
    return R.resample_mean(readings(spark, sf_dir), keys, every, digits=2)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.forward_fill(R.fill_long_gaps_zero(grid(spark, sf_dir), KEYS, 12), KEYS, 6)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = filled(spark, sf_dir).withColumn("raw", N.threshold_status("x", LOW, HIGH))
    return S.status(raw, KEYS, MIN_ON, MIN_OFF, MIN_ACTIVATION)


def windows(spark: SparkSession, sf_dir: str, stride: int | None = None) -> DataFrame:
    """house, appliance, win, step, k, x, status of whole windows."""
    return W.cut(states(spark, sf_dir), KEYS, SIZE, stride, dense=True).select(*KEYS, "win", "step", "k", "x", "status")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """house, appliance, k, ts, y, p, s, q: the bucket before stands for a prediction."""
    df = states(spark, sf_dir).withColumn("p", F.coalesce(F.lag("x").over(R.over_time(KEYS)), F.lit(0.0)))
    return df.select(*KEYS, "k", N.from_seconds(F.col("k") * HOUR).alias("ts"), F.coalesce("x", F.lit(0.0)).alias("y"), "p", F.col("status").alias("s"), N.predicted_state("p", LOW).alias("q"))


_O = "partition by house, appliance order by k"
CTE = {
    "r": "r as (select user_id % 4 as house, event_type as appliance, ts, value as watts, event_id, user_id from events)",
    "m": "m as (select house, appliance, cast(floor(epoch(ts) / 3600) as bigint) as k, cast(sum(cast(watts as decimal(18,2))) as double) / count(watts) as x from r group by 1, 2, 3)",
    "g": "g as (select i.house, i.appliance, i.k, m.x from (select house, appliance, unnest(range(min(k), max(k) + 1)) as k from m group by 1, 2) i left join m using (house, appliance, k))",
    "z1": f"z1 as (select *, case when lag(x is null) over ({_O}) is null or (x is null) <> lag(x is null) over ({_O}) then 1 else 0 end as edge from g)",
    "z2": f"z2 as (select *, sum(edge) over ({_O}) as run from z1)",
    "z": "z as (select house, appliance, k, case when x is null and count(*) over (partition by house, appliance, run) > 12 then 0.0 else x end as x from z2)",
    "f": f"f as (select house, appliance, k, last_value(x ignore nulls) over ({_O} rows between 6 preceding and current row) as x from z)",
    "b0": "b0 as (select *, case when x between 40 and 300 then 1 else 0 end as raw from f)",
    "b1": f"b1 as (select *, max(case when raw = 1 then k end) over ({_O} rows between unbounded preceding and current row) as p, min(case when raw = 1 then k end) over ({_O} rows between current row and unbounded following) as n from b0)",
    "b2": "b2 as (select house, appliance, k, x, raw, case when raw = 1 or coalesce(n - p - 1 <= 2, false) then 1 else 0 end as c from b1)",
    "b3": f"b3 as (select *, case when lag(c) over ({_O}) is null or c <> lag(c) over ({_O}) then 1 else 0 end as edge from b2)",
    "b4": f"b4 as (select *, sum(edge) over ({_O}) as run from b3)",
    "st": "st as (select house, appliance, k, x, raw, c, cast(case when c = 1 and count(*) over (partition by house, appliance, run) >= 2 then 1 else 0 end as integer) as status from b4)",
    "w0": f"w0 as (select *, row_number() over ({_O}) - 1 as pos from st)",
    "w1": "w1 as (select house, appliance, cast(pos // 24 as bigint) as win, cast(pos % 24 as bigint) as step, k, x, status from w0)",
    "w": "w as (select * from (select *, count(*) over (partition by house, appliance, win) as n from w1) where n = 24)",
    "sc": f"sc as (select house, appliance, k, timestamp '1970-01-01' + to_seconds(k * 3600) as ts, coalesce(x, 0.0) as y, coalesce(lag(x) over ({_O}), 0.0) as p, status as s, cast(case when coalesce(lag(x) over ({_O}), 0.0) > 40 then 1 else 0 end as integer) as q from st)",
}
CHAIN = ["r", "m", "g", "z1", "z2", "z", "f", "b0", "b1", "b2", "b3", "b4", "st"]


def upto(name: str, *more: str) -> str:
    """The WITH clause of all steps up to name, and more CTEs given as text."""
    if name in CHAIN:
        steps = CHAIN[: CHAIN.index(name) + 1]
    else:
        steps = CHAIN + (["w0", "w1", "w"] if name == "w" else ["sc"])
    return "with " + ", ".join([CTE[s] for s in steps] + list(more)) + " "
