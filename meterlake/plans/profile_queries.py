"""Registered queries: the whole preparation per source layout, and windows made from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import windows as W
from meterlake.plans.base import KEYS, query, readings
from meterlake.plans.profiles import Profile, Rules, prepare
from meterlake.plans.series_queries import scratch
from meterlake.sources import lake

NAMES = ["click", "error", "purchase", "signup", "view"]


def _profile(layout: str, names: list[str] = NAMES, **kw) -> Profile:
    rules = {n: Rules(40.0, 300.0, 2, 2, 1) for n in names}
    return Profile(layout, rules, every=3600, cutoff=200.0, factor=3, **kw)


def _rows(spark, sf):
    """Every event is a channel reading, and a reading of its house's mains."""
    rows = readings(spark, sf).withColumn("meter", F.col("user_id") % 2).withColumn("issue", (F.col("event_id") % 50 == 0).cast("int"))
    return rows.unionByName(rows.withColumn("appliance", F.lit("aggregate")))


def _round(df):
    return df.select(*KEYS, "k", F.round("x", 5).alias("x"), "status", F.round("total", 5).alias("total"))


_O = "partition by house, appliance order by k"


def _sql(source: str, meters: bool, long_gap: bool, fill: int, tail: str, anchor: bool = False) -> str:
    part = "house, appliance, meter" if meters else "house, appliance"
    order = f"partition by {part} order by k"
    on = f"using ({part}, k)"
    out = f"""with r0 as ({source}), r as (select * from r0 union all select house, 'aggregate', ts, watts, meter from r0),
    m as (select {part}, cast(floor(epoch(ts) / 3600) as bigint) as k, avg(watts) as x from r group by all),
    g as (select i.*, m.x from (select {part}, unnest(range(min(k), max(k) + 1)) as k from m group by {part}) i left join m {on}),"""
    main = f"select house, k, last_value(x ignore nulls) over ({order} rows between {fill} preceding and current row) as x{', meter' if meters else ''} from g where appliance = 'aggregate'"
    out += f" ma as ({main})," + (" mb as (select house, k, sum(x) as x from ma group by 1, 2)," if meters else " mb as (select house, k, x from ma),")
    if anchor:
        out = out.replace(" mb as (", " m0 as (") + " an as (select house, min(k) as first from m0 where k % 24 = 0 group by 1), mb as (select house, k, x from m0 join an using (house) where k >= first),"
    out += " ca as (select house, appliance, k, sum(x) as x from g where appliance <> 'aggregate' group by 1, 2, 3)," if meters else " ca as (select house, appliance, k, x from g where appliance <> 'aggregate'),"
    if long_gap:
        out += f" c1 as (select *, case when lag(x is null) over ({_O}) is distinct from (x is null) then 1 else 0 end as edge from ca), c2 as (select *, sum(edge) over ({_O}) as run from c1), cb as (select house, appliance, k, case when x is null and count(*) over (partition by house, appliance, run) > 12 then 0.0 else x end as x from c2),"
    else:
        out += " cb as (select * from ca),"
    out += f""" cc as (select house, appliance, k, last_value(x ignore nulls) over ({_O} rows between {fill} preceding and current row) as x from cb),
    b as (select house, appliance, k, case when cc.x < 5 then 0.0 when cc.x > 200 then 200.0 else cc.x end as x, case when mb.x < 5 then 0.0 when mb.x > 200 then 200.0 else mb.x end as total from mb join cc using (house, k)),
    s0 as (select *, case when x between 40 and 300 then 1 else 0 end as raw from b),
    s1 as (select *, max(case when raw = 1 then k end) over ({_O} rows between unbounded preceding and current row) as p, min(case when raw = 1 then k end) over ({_O} rows between current row and unbounded following) as n from s0),
    s2 as (select *, case when raw = 1 or coalesce(n - p - 1 <= 2, false) then 1 else 0 end as c from s1),
    s3 as (select *, case when lag(c) over ({_O}) is distinct from c then 1 else 0 end as edge from s2), s4 as (select *, sum(edge) over ({_O}) as run from s3),
    s as (select house, appliance, k, x, total, case when x is not null then case when c = 1 and count(*) over (partition by house, appliance, run) >= 2 then 1 else 0 end end as status from s4),
    d as (select house, appliance, cast(floor(k / 3) as bigint) as k, avg(x) as x, avg(status) as status, avg(total) as total from s group by 1, 2, 3) """
    return out + tail


_EVENTS = "select user_id % 4 as house, event_type as appliance, ts, value as watts, user_id % 2 as meter from events"
_CLEAN = "select user_id % 4 as house, event_type as appliance, ts, value as watts, user_id % 2 as meter from events e where not exists (select 1 from events i where i.event_id % 50 = 0 and i.user_id % 4 = e.user_id % 4 and i.ts = e.ts)"
_HARD = "cast(case when status is not null then cast(status > 0 as integer) end as integer) as status"


@query("profile_channel_files", _sql(_EVENTS, False, True, 6, f"select house, appliance, k, round(x, 5) as x, {_HARD}, round(total, 5) as total from d"))
def channels(spark, sf):
    return _round(prepare(_rows(spark, sf), _profile("channels")))


@query("profile_wide_files", _sql(_CLEAN, False, False, 9, "select house, appliance, k, round(x, 5) as x, round(status, 5) as status, round(total, 5) as total from d"))
def wide(spark, sf):
    made = prepare(_rows(spark, sf), _profile("wide", fill=9, soft_label=True))
    return _round(made).withColumn("status", F.round("status", 5))


@query("profile_meter_tables", _sql(_EVENTS, True, True, 6, f", y as (select house, k, sum(coalesce(x, 0)) as total from d where appliance in ('purchase', 'view') group by 1, 2) select d.house, d.appliance, d.k, round(d.x, 5) as x, {_HARD}, round(y.total, 5) as total from d left join y using (house, k)"))
def meters(spark, sf):
    return _round(prepare(_rows(spark, sf), _profile("meters", synthetic=["purchase", "view"])))


@query("profile_windows", _sql(_EVENTS, False, True, 6, ", n as (select *, row_number() over (partition by house, appliance order by k) - 1 as pos from d), w as (select house, appliance, cast(pos // 8 as bigint) as win, count(*) as n, sum(cast(x is null or total is null as integer)) as gaps, sum(x) as energy, max(cast(coalesce(status, 0) > 0 as integer)) as label from n group by 1, 2, 3) select house, appliance, win, round(energy, 4) as energy, label from w where n = 8 and gaps = 0"))
def day_windows(spark, sf):
    made = W.cut(prepare(_rows(spark, sf), _profile("channels")), KEYS, 8)
    whole = W.drop_gappy(made, KEYS, ["x", "total"])
    labels = W.has_on(whole.fillna(0, ["status"]), KEYS)
    return W.energy(whole, KEYS).join(labels, [*KEYS, "win"]).select(*KEYS, "win", F.round("energy", 4).alias("energy"), "label")


@query("profile_anchored", _sql(_EVENTS, False, True, 6, f"select house, appliance, k, round(x, 5) as x, {_HARD}, round(total, 5) as total from d", anchor=True))
def anchored(spark, sf):
    return _round(prepare(_rows(spark, sf), _profile("channels", anchor="day", chunk=500)))


@query("profile_extra_channels", _sql(_EVENTS, False, True, 6, f", y as (select house, k, sum(coalesce(x, 0)) as total from d where appliance in ('purchase', 'view') group by 1, 2) select d.house, d.appliance, d.k, round(d.x, 5) as x, {_HARD}, round(y.total, 5) as total from d left join y using (house, k) where appliance in ('click', 'error', 'purchase')"))
def extra_channels(spark, sf):
    """'view' has no rules: it counts in the synthetic aggregate only."""
    return _round(prepare(_rows(spark, sf), _profile("channels", ["click", "error", "purchase"], synthetic=["purchase", "view"])))


@query("s17_prepared_by_appends", _sql(_EVENTS, False, True, 6, f"select house, appliance, k, round(x, 5) as x, {_HARD}, round(total, 5) as total from d"))
def appended(spark, sf):
    """Three appends: the earlier half of the readings but for a tenth, the later half, and that tenth, late."""
    rows = _rows(spark, sf)
    ends = rows.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("hi"))
    early = F.unix_micros(F.col("ts").cast("timestamp")) < (F.col("lo") + F.col("hi")) / 2
    dealt = rows.crossJoin(F.broadcast(ends)).withColumn("part", F.when(~early, 1).when(F.col("event_id") % 10 == 3, 2).otherwise(0)).drop("lo", "hi")
    path = scratch(spark)
    for part in range(3):
        lake.append(spark, path, f"b{part}", dealt.where(F.col("part") == part).drop("part"), _profile("channels"))
    return _round(lake.prepared(spark, path))
