"""Registered queries: joins in time, table functions, summaries, exact quantiles, sources by format, appends."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions import numeric as N, table_functions
from meterlake.operators import segments, status as S, summaries as Y, temporal as T
from meterlake.plans.base import HOUR, KEYS, filled, query, readings, states, upto
from meterlake.plans.series_queries import _DIM, _WIDE, ALL, _channels, _written_channels, scratch, written_houses
from meterlake.sources import formats


@query(
    "t1_as_of_join",
    upto("r", "q as (select house, ts, max(watts) as watts from r where appliance = 'view' group by 1, 2)")
    + "select l.event_id, l.house, l.watts, case when l.ts - q.ts <= interval 6 hours then q.ts end as last_ts, case when l.ts - q.ts <= interval 6 hours then q.watts end as last_watts from (select * from r where appliance = 'purchase') l asof left join q on l.house = q.house and l.ts >= q.ts",
)
def t1(spark, sf):
    rows = readings(spark, sf).select("event_id", "house", "appliance", "ts", "watts")
    left = rows.where("appliance = 'purchase'").drop("appliance")
    right = rows.where("appliance = 'view'").select("house", "ts", "watts")
    found = T.as_of(left, right, ["house"], ["watts"], tolerance_s=6 * HOUR, slice_s=2 * HOUR)
    return found.select("event_id", "house", "watts", "last_ts", "last_watts")


_PERIODS = "o as (select house, event_id, cast(floor(epoch(ts) / 3600) as bigint) as s, cast(floor(epoch(ts) / 3600) as bigint) + case when event_id % 97 = 0 then 400 else 1 + user_id % 7 end as e from r where appliance = 'error')"


@query(
    "t2_interval_join",
    upto("st", _PERIODS, "ed as (select *, case when lag(status) over (partition by house, appliance order by k) is distinct from status then 1 else 0 end as edge from st)", "rn as (select *, sum(edge) over (partition by house, appliance order by k) as run from ed)", "ac as (select house, appliance, min(k) as s, max(k) + 1 as e from rn where status = 1 group by house, appliance, run)")
    + 'select ac.house, ac.appliance, ac.s as start_k, ac.e as end_k, o.event_id as outage, least(ac.e, o.e) - greatest(ac.s, o.s) as "overlap" from ac join o on ac.house = o.house and ac.s < o.e and o.s < ac.e',
)
def t2(spark, sf):
    k = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / HOUR)
    hours = F.when(F.col("event_id") % 97 == 0, 400).otherwise(1 + F.col("user_id") % 7)
    outages = readings(spark, sf).where("appliance = 'error'").select("house", "event_id", k.alias("start_k"), (k + hours).alias("end_k"))
    active = S.activations(states(spark, sf), KEYS).select(*KEYS, "start_k", "end_k")
    found = T.overlaps(active, outages, ["house"], "start_k", "end_k", bucket=8, fan=4)
    return found.select(*KEYS, "start_k", "end_k", F.col("r_event_id").alias("outage"), "overlap")


@query("t3_last_known_aligned", upto("f") + "select house, k, max(case when appliance = 'purchase' then v end) as purchase, max(case when appliance = 'view' then v end) as view from (select house, appliance, k, last_value(x ignore nulls) over (partition by house, appliance order by k rows between unbounded preceding and current row) as v from f where appliance in ('purchase', 'view')) group by 1, 2")
def t3(spark, sf):
    rows = filled(spark, sf).where(F.col("appliance").isin("purchase", "view"))
    known = segments.carry_last(rows, KEYS, {"v": "x"}, size=72)
    one = lambda a: F.max(F.when(F.col("appliance") == a, F.col("v"))).alias(a)
    return known.groupBy("house", "k").agg(one("purchase"), one("view"))


# --- sources by format: what the scans of the same layouts give --------------------------------------


@query("s1_channels_by_format", upto("r", _DIM) + "select cast(house as integer) as house, channel, date_trunc('second', ts) as ts, watts from r join d using (appliance) where house in (1, 2) and channel <> 2")
def s1_format(spark, sf):
    formats.register(spark)
    rows = spark.read.format("meter_channels").load(_written_channels(spark, sf))
    return rows.where("house in (1, 2) and channel <> 2").withColumn("ts", N.from_seconds(F.unix_seconds("ts")))


@query("s2_labels_by_format", upto("r", _DIM) + "select 2 as house, channel, appliance from d where exists (select 1 from r where house = 2)")
def s2_format(spark, sf):
    formats.register(spark)
    path = scratch(spark)
    names = _channels(spark, sf)
    doubled = names.unionByName(names.withColumn("channel", F.col("channel") + 100))
    readings(spark, sf).select("house").distinct().crossJoin(doubled).select("house", "channel", "appliance").write.partitionBy("house").option("sep", " ").csv(path)
    return spark.read.format("meter_labels").load(path).where("house = 2")


@query("s3_houses_by_format", upto("m") + f"select cast(house as integer) as house, cast(o.i as integer) as ordinal, timestamp '1970-01-01' + to_seconds(k * 3600) as ts, round(max(case when {_WIDE} then x end), 6) as watts from m cross join (select unnest(range({len(ALL)})) as i) o where house <> 1 group by 1, 2, 3, k")
def s3_format(spark, sf):
    formats.register(spark)
    rows = spark.read.format("meter_houses").load(written_houses(spark, sf)).where("house <> 1")
    return rows.select("house", "ordinal", F.col("ts").cast("timestamp_ntz").alias("ts"), "watts")


# --- table functions ---------------------------------------------------------------------------------


def _by_sql(spark, sf, text: str):
    table_functions.register(spark)
    return spark.sql(text, rows=states(spark, sf).select(*KEYS, "k", "x", "status"))


@query("w1_windows_by_sql", upto("w") + "select house, appliance, win, step, k, x, status from w")
def w1_sql(spark, sf):
    return _by_sql(spark, sf, "select house, appliance, win, step, k, x, status from cut_windows(rows => table({rows}) partition by (house, appliance) order by k, size => 24)")


@query("w3_whole_windows_by_sql", upto("w") + "select house, appliance, win, step, k, x from (select *, sum(cast(x is null as integer)) over (partition by house, appliance, win) as gaps from w) where gaps = 0")
def w3_sql(spark, sf):
    return _by_sql(spark, sf, "select house, appliance, win, step, k, x from cut_windows(rows => table({rows}) partition by (house, appliance) order by k, size => 24, whole => 'x')")


# --- summaries and exact quantiles -------------------------------------------------------------------


@query(
    "q1_merged_summaries",
    upto("r") + "select house, appliance, count(watts) as n, min(watts) as low, max(watts) as high, round(sum(watts), 2) as total, true as median_is_near, true as times_are_near from r group by 1, 2",
)
def q1(spark, sf):
    rows = readings(spark, sf).select(*KEYS, "ts", "watts")
    one = Y.merge(Y.summarise(rows, KEYS), KEYS)
    told = one.select(*KEYS, "n", "low", "high", "total", Y.quantile(0.5).alias("median"), Y.distinct_times().alias("times"))
    exact = rows.join(told.select(*KEYS, "median"), KEYS).groupBy(*KEYS).agg((F.count_if(F.col("watts") < F.col("median")) / F.count("*")).alias("less"), (F.count_if(F.col("watts") <= F.col("median")) / F.count("*")).alias("upto"), F.count_distinct("ts").alias("true_times"))
    near = (F.col("less") <= 0.52) & (F.col("upto") >= 0.48)
    return told.join(exact, KEYS).select(*KEYS, "n", "low", "high", F.round("total", 2).alias("total"), near.alias("median_is_near"), (F.abs(F.col("times") / F.col("true_times") - 1) < 0.05).alias("times_are_near"))


@query("q2_exact_quantiles", upto("r") + "select house, appliance, unnest([0.0, 0.1, 0.5, 0.9, 1.0]) as q, unnest([quantile_disc(watts, 0.0), quantile_disc(watts, 0.1), quantile_disc(watts, 0.5), quantile_disc(watts, 0.9), quantile_disc(watts, 1.0)]) as x from r group by 1, 2")
def q2(spark, sf):
    return Y.exact_quantiles(readings(spark, sf), KEYS, "watts", [0.0, 0.1, 0.5, 0.9, 1.0], limit=50).select(*KEYS, "q", "x")


@query("k14_fit_robust", upto("r") + "select appliance, quantile_disc(watts, 0.5) as stat1, quantile_disc(watts, 0.75) - quantile_disc(watts, 0.25) as stat2 from r group by 1")
def k14(spark, sf):
    return Y.fit_robust(readings(spark, sf), ["appliance"], "watts", limit=200)
