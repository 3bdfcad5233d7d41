"""Registered queries: sources, scalars, gap filling, joins, state, windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlake.functions import numeric as N
from meterlake.operators import align as J, regularise as R, status as S, windows as W
from meterlake.plans.base import HIGH, HOUR, KEYS, LOW, SIZE, filled, grid, query, readings, states, table, upto, windows
from meterlake.sources import known, readings as IN, results as OUT
from meterlake.sources.folders import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder for a round trip, in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"


# --- scalars and filters -------------------------------------------------------------------------


@query("p1_drop_issue_rows", upto("r") + "select event_id, house, ts, watts from r where not exists (select 1 from r i where i.event_id % 50 = 0 and i.house = r.house and i.ts = r.ts)")
def p1(spark, sf):
    rows = readings(spark, sf).withColumn("issue", (F.col("event_id") % 50 == 0).cast("int"))
    return J.drop_issue_rows(rows, "issue", ["house", "ts"]).select("event_id", "house", "ts", "watts")


@query("p2_noise_floor", "select event_id, case when value < 5 then 0.0 else value end as watts from events")
def p2(spark, sf):
    return readings(spark, sf).select("event_id", N.noise_floor("watts").alias("watts"))


@query("p3_clip", "select event_id, case when value > 100 then 100.0 when value < 0 then 0.0 else value end as watts from events")
def p3(spark, sf):
    return readings(spark, sf).select("event_id", N.clip("watts", 100.0).alias("watts"))


def _with_ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", N.from_seconds(F.col("k") * HOUR))


@query("p4_anchor_to_day", upto("g", "t as (select *, timestamp '1970-01-01' + to_seconds(k * 3600) as ts from g), a as (select house, appliance, min(ts) as first from t where hour(ts) = 0 group by 1, 2)") + "select house, appliance, k, x, ts from t join a using (house, appliance) where ts >= first")
def p4(spark, sf):
    return J.anchor(_with_ts(grid(spark, sf)), KEYS)


@query("p5_anchor_to_week", upto("g", "t as (select *, timestamp '1970-01-01' + to_seconds(k * 3600) as ts from g), a as (select house, appliance, min(ts) as first from t where hour(ts) = 0 and isodow(ts) = 2 group by 1, 2)") + "select house, appliance, k, x, ts from t join a using (house, appliance) where ts >= first")
def p5(spark, sf):
    return J.anchor(_with_ts(grid(spark, sf)), KEYS, weekday=1)


@query("p6_threshold_status", upto("f") + "select house, appliance, k, cast(case when x is not null then case when x between 40 and 300 then 1 else 0 end end as integer) as status from f")
def p6(spark, sf):
    return filled(spark, sf).select(*KEYS, "k", N.restore_missing(N.threshold_status("x", LOW, HIGH), "x").alias("status"))


@query(
    "p7_param_sets",
    upto(
        "f",
        "d as (select appliance, cast(10 * n as integer) as lo, 300 as hi, cast(n % 3 + 1 as integer) as min_on, cast(n % 2 + 1 as integer) as min_off from (select appliance, row_number() over (order by appliance) as n from (select distinct appliance from r))), "
        "c0 as (select f.*, d.min_on, d.min_off, case when x between lo and hi then 1 else 0 end as raw from f join d using (appliance)), "
        "c1 as (select *, max(case when raw = 1 then k end) over (partition by house, appliance order by k rows between unbounded preceding and current row) as p, min(case when raw = 1 then k end) over (partition by house, appliance order by k rows between current row and unbounded following) as n from c0), "
        "c2 as (select *, case when raw = 1 or coalesce(n - p - 1 <= min_off, false) then 1 else 0 end as c from c1), c3 as (select *, case when lag(c) over (partition by house, appliance order by k) is distinct from c then 1 else 0 end as edge from c2), c4 as (select *, sum(edge) over (partition by house, appliance order by k) as run from c3)",
    )
    + "select house, appliance, k, cast(case when c = 1 and count(*) over (partition by house, appliance, run) >= min_on then 1 else 0 end as integer) as status from c4",
)
def p7(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("appliance"))
    params = readings(spark, sf).select("appliance").distinct().withColumn("n", n)
    params = params.select("appliance", (10 * F.col("n")).alias("min_threshold"), F.lit(300).alias("max_threshold"), (F.col("n") % 3 + 1).alias("min_on"), (F.col("n") % 2 + 1).alias("min_off"), F.lit(1).alias("min_activation"))
    return S.status_by_params(filled(spark, sf), params, KEYS).select(*KEYS, "k", "status")


@query("p8_absent_appliance_zero", upto("m", "a as (select distinct house, k from m), n as (select distinct appliance from m), v as (select * from m where not (house = 3 and appliance = (select min(appliance) from m)))") + "select a.house, a.k, n.appliance, coalesce(v.x, 0.0) as x from a cross join n left join v on v.house = a.house and v.k = a.k and v.appliance = n.appliance")
def p8(spark, sf):
    means = R.bucket_means(readings(spark, sf), KEYS, HOUR, digits=2)
    names = ALL
    # one appliance is left out of one house; its buckets there come back as 0
    full, absent = means.select("house", "k").distinct(), means.where(~((F.col("house") == 3) & (F.col("appliance") == names[0])))
    return J.absent_appliances_zero(absent.join(full, ["house", "k"], "right"), names, ["house", "k"], ["x"]).select("house", "k", "appliance", "x")


_P9 = upto("st", "d as (select house, appliance, cast(floor(k / 3) as bigint) as k, avg(x) as x, avg(status) as share from st group by 1, 2, 3)")


@query("p9_hard_or_soft_label", _P9 + "select house, appliance, k, cast(case when share > 0 then 1 else 0 end as integer) as hard, round(share, 6) as soft from d")
def p9(spark, sf):
    down = R.downsample(states(spark, sf), KEYS, 3, ["x", "status"])
    return down.select(*KEYS, "k", N.hard_label("status").alias("hard"), F.round("status", 6).alias("soft"))


@query("p10_aggregate_state", upto("f") + "select house, k, cast(case when sum(x) > 0 then 1 else 0 end as integer) as state from f where x is not null group by 1, 2")
def p10(spark, sf):
    agg = R.sum_meters(filled(spark, sf), ["house"]).where("x is not null")
    return agg.select("house", "k", N.aggregate_state("x").alias("state"))


@query("p11_select_channels", upto("st") + "select house, k, " + ", ".join(f"max(case when appliance = '{a}' then x end) as {a}_power, max(case when appliance = '{a}' then status end) as {a}_state" for a in ("purchase", "view")) + " from st group by 1, 2")
def p11(spark, sf):
    return J.select_channels(states(spark, sf), ["purchase", "view"], ["house", "k"])


#: The event types, in order, under names of a public dataset.
_NAMED = {"click": "dishwasher", "error": "fridge", "purchase": "kettle", "signup": "microwave", "view": "washing_machine"}
_NAME_SQL = "case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in _NAMED.items()) + " end"


def _named(spark, sf) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in _NAMED.items() for x in kv))
    return readings(spark, sf).withColumn("appliance", F.element_at(names, F.col("appliance")))


@query("p7_known_rules", "with v(appliance, lo, hi) as (values " + ", ".join(f"('{a}', {low}, {high})" for a, (low, high, *_) in known.DURATION_RULES["ukdale"].items()) + f"), r as (select event_id, {_NAME_SQL} as appliance, value * 10 as watts from events) select event_id, appliance, cast(case when watts between lo and hi then 1 else 0 end as integer) as raw from r join v using (appliance)")
def p7_known(spark, sf):
    rows = _named(spark, sf).withColumn("watts", F.col("watts") * 10).join(F.broadcast(known.rule_table(spark, "ukdale")), "appliance")
    return rows.select("event_id", "appliance", N.threshold_status("watts", F.col("min_threshold"), F.col("max_threshold")).alias("raw"))


_V = ", ".join(f"('{a}', {', '.join(map(str, r))})" for a, r in known.DURATION_RULES["ukdale"].items())
_W7 = "partition by house, appliance order by k"


@query(
    "p7_known_durations",
    f"with v(appliance, lo, hi, min_on, min_off, min_act) as (values {_V}), r as (select user_id % 4 as house, {_NAME_SQL} as appliance, ts, value * 10 as watts from events), "
    "m as (select house, appliance, cast(floor(epoch(ts) / 900) as bigint) as k, avg(watts) as x from r group by 1, 2, 3), "
    "g as (select i.*, m.x from (select house, appliance, unnest(range(min(k), max(k) + 1)) as k from m group by 1, 2) i left join m using (house, appliance, k)), "
    f"f as (select house, appliance, k, last_value(x ignore nulls) over ({_W7} rows between 6 preceding and current row) as x from g), "
    "c0 as (select f.*, v.*, case when x between lo and hi then 1 else 0 end as raw from f join v using (appliance)), "
    f"c1 as (select *, max(case when raw = 1 then k end) over ({_W7} rows between unbounded preceding and current row) as p, min(case when raw = 1 then k end) over ({_W7} rows between current row and unbounded following) as n from c0), "
    "c2 as (select *, case when raw = 1 or coalesce(n - p - 1 <= min_off, false) then 1 else 0 end as c from c1), "
    f"c3 as (select *, case when lag(c) over ({_W7}) is distinct from c then 1 else 0 end as edge from c2), c4 as (select *, sum(edge) over ({_W7}) as run from c3) "
    "select house, appliance, k, cast(case when c = 1 and count(*) over (partition by house, appliance, run) >= greatest(min_on, min_act) then 1 else 0 end as integer) as status from c4",
)
def p7_durations(spark, sf):
    rows = _named(spark, sf).withColumn("watts", F.col("watts") * 10)
    full = R.forward_fill(R.resample_mean(rows, KEYS, 900), KEYS, 6)
    return S.status_by_params(full, known.rule_table(spark, "ukdale"), KEYS).select(*KEYS, "k", "status")


@query("p12_validate_appliances", f"select {_NAME_SQL} as appliance, count(*) as n from events group by 1")
def p12(spark, sf):
    rows = _named(spark, sf)
    names = J.check_names([r[0] for r in rows.select("appliance").distinct().collect()], known.APPLIANCES["ukdale"])
    return rows.where(F.col("appliance").isin(names)).groupBy("appliance").agg(F.count("*").alias("n"))


@query("s5_known_meters", "with v(house, appliance, meters) as (values " + ", ".join(f"({h}, '{a}', {m})" for h, own in known.METERS.items() for a, m in own.items()) + "), n as (select distinct appliance from v), h as (select distinct cast(user_id % 8 as integer) as house from events) select h.house, n.appliance, u.meter from h cross join n left join (select house, appliance, unnest(meters) as meter from v) u on u.house = h.house and u.appliance = n.appliance")
def s5_known(spark, sf):
    houses = readings(spark, sf).select((F.col("user_id") % 8).cast("int").alias("house"))
    return IN.meter_map(houses, known.meter_table(spark))


@query("l5_known_houses", "with v(appliance, house, split) as (values " + ", ".join(f"('{a}', {h}, '{s}')" for a, lists in known.HOUSE_LISTS["ukdale"].items() for s, houses in zip(("train", "valid", "test"), lists) for h in houses) + f"), r as (select event_id, {_NAME_SQL} as appliance, cast(user_id % 6 as integer) as house from events) select event_id, appliance, house, split from r join v using (appliance, house)")
def l5_known(spark, sf):
    from meterlake.operators.splits import split_fixed

    rows = _named(spark, sf).select("event_id", "appliance", (F.col("user_id") % 6).cast("int").alias("house"))
    return split_fixed(rows, known.split_table(spark, "ukdale")).select("event_id", "appliance", "house", "split")


@query("p13_small_prediction_zero", upto("sc") + "select house, appliance, k, case when p < 40 then 0.0 else p end as p from sc")
def p13(spark, sf):
    from meterlake.plans.base import scored

    return scored(spark, sf).select(*KEYS, "k", N.small_to_zero("p", LOW).alias("p"))


@query("p14_predicted_state", upto("sc") + "select house, appliance, k, cast(case when p > 50 then 1 else 0 end as integer) as q, cast(case when p > 40 then 1 else 0 end as integer) as q_default from sc")
def p14(spark, sf):
    from meterlake.plans.base import scored

    return scored(spark, sf).select(*KEYS, "k", N.predicted_state("p", LOW, 50.0).alias("q"), N.predicted_state("p", LOW).alias("q_default"))


@query("p15_cutoff_and_gate", "select event_id, case when v >= 20 then v else 0.0 end as power, cast(case when v >= 20 then 1 else 0 end as integer) as state from (select event_id, case when value < 5 then 0.0 when value > 200 then 200.0 else value end as v from events)")
def p15(spark, sf):
    power, state = N.cutoff_and_gate("watts", 200.0, 20.0)
    return readings(spark, sf).select("event_id", power.alias("power"), state.alias("state"))


@query("p16_nan_to_num", "select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 or event_id % 13 = 0 then 0.0 else value end as x from events")
def p16(spark, sf):
    spoilt = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("watts"))
    return readings(spark, sf).select("event_id", N.finite_or_zero(spoilt).alias("x"))


@query("p17_range_slice", upto("g") + "select house, appliance, k, x, pos from (select *, cast(row_number() over (partition by house, appliance order by k) - 1 as bigint) as pos from g) where pos between 10 and 60")
def p17(spark, sf):
    return W.range_slice(grid(spark, sf), KEYS, 10, 60, dense=True)


@query("p17_range_slice_with_holes", upto("m") + "select house, appliance, k, x, pos from (select *, cast(row_number() over (partition by house, appliance order by k) - 1 as bigint) as pos from m) where pos between 10 and 60")
def p17_holes(spark, sf):
    return W.range_slice(R.bucket_means(readings(spark, sf), KEYS, HOUR, digits=2), KEYS, 10, 60)


@query("p18_decimate", upto("g") + "select house, appliance, k, x from (select *, row_number() over (partition by house, appliance order by k) - 1 as pos, greatest(1, count(*) over (partition by house, appliance) // 100) as each from g) where pos % each = 0")
def p18(spark, sf):
    return W.decimate(grid(spark, sf), KEYS, 100, dense=True).select(*KEYS, "k", "x")


@query("p19_middle_quantile", "select event_id, value as mid from events")
def p19(spark, sf):
    return readings(spark, sf).select("event_id", N.middle_quantile(F.array(F.col("watts") * 0.5, F.col("watts"), F.col("watts") * 1.5)).alias("mid"))


# --- regularisation ------------------------------------------------------------------------------


@query("g1_resample_mean", upto("g") + "select house, appliance, k, x from g")
def g1(spark, sf):
    return grid(spark, sf)


@query("g2_ffill_limit", upto("g") + "select house, appliance, k, last_value(x ignore nulls) over (partition by house, appliance order by k rows between 6 preceding and current row) as x from g")
def g2(spark, sf):
    return R.forward_fill(grid(spark, sf), KEYS, 6)


@query("g3_fill_long_gaps_zero", upto("z") + "select house, appliance, k, x from z")
def g3(spark, sf):
    return R.fill_long_gaps_zero(grid(spark, sf), KEYS, 12)


@query("g3_g2_gap_fill", upto("f") + "select house, appliance, k, x from f")
def g32(spark, sf):
    return filled(spark, sf)


@query("g3_g2_gap_fill_in_chunks", upto("f") + "select house, appliance, k, x from f")
def g32_chunks(spark, sf):
    rule = lambda df, keys: R.forward_fill(R.fill_long_gaps_zero(df, keys, 12), keys, 6)
    return R.in_chunks(grid(spark, sf), KEYS, 100, 6 + 13, rule)


@query("g4_downsample_mean", upto("f", "d as (select house, appliance, cast(floor(k / 6) as bigint) as k, avg(x) as x from f group by 1, 2, 3)") + "select house, appliance, k, round(x, 6) as x from d")
def g4(spark, sf):
    return R.downsample(filled(spark, sf), KEYS, 6, ["x"]).select(*KEYS, "k", F.round("x", 6).alias("x"))


@query("g5_sum_meters", "with m as (select user_id % 4 as house, event_type as appliance, user_id % 2 as meter, cast(floor(epoch(ts) / 3600) as bigint) as k, cast(sum(cast(value as decimal(18,2))) as double) / count(value) as x from events group by all) select house, appliance, k, round(sum(x), 6) as x from m group by all")
def g5(spark, sf):
    rows = readings(spark, sf).withColumn("meter", F.col("user_id") % 2)
    meters = R.bucket_means(rows, [*KEYS, "meter"], HOUR, digits=2)
    return R.sum_meters(meters, KEYS).select(*KEYS, "k", F.round("x", 6).alias("x"))


@query("g6_to_local_time", "select event_id, cast(timezone('US/Eastern', timezone('UTC', ts)) as timestamp) as local_ts from events")
def g6(spark, sf):
    zone = spark.conf.get("spark.sql.session.timeZone")
    utc = F.to_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    local = R.local_time(F.from_utc_timestamp(utc, zone))
    return readings(spark, sf).select("event_id", local.cast("timestamp_ntz").alias("local_ts"))


@query("g7_synthetic_aggregate", upto("f") + "select house, k, round(sum(coalesce(x, 0)), 6) as x from f where appliance in ('purchase', 'view') group by 1, 2")
def g7(spark, sf):
    return R.synthetic_aggregate(filled(spark, sf), ["house"], ["purchase", "view"]).select("house", "k", F.round("x", 6).alias("x"))


# --- joins -----------------------------------------------------------------------------------------

_AGG = "a as (select house, k, sum(x) as total from f where x is not null group by 1, 2)"


def _aggregate(spark, sf) -> DataFrame:
    return R.sum_meters(filled(spark, sf).where("x is not null"), ["house"]).withColumnRenamed("x", "total")


@query("j1_align_inner", upto("f", _AGG) + "select house, appliance, k, x, round(total, 6) as total from f join a using (house, k)")
def j1(spark, sf):
    return J.align_inner(filled(spark, sf), _aggregate(spark, sf), ["house", "k"]).select(*KEYS, "k", "x", F.round("total", 6).alias("total"))


@query("j2_align_left", upto("f", _AGG + ", v as (select house, k, x from f where appliance = 'purchase')") + "select house, k, round(total, 6) as total, coalesce(v.x, 0.0) as x from a left join v using (house, k)")
def j2(spark, sf):
    one = filled(spark, sf).where("appliance = 'purchase'").select("house", "k", "x")
    return J.align_left_zero(_aggregate(spark, sf), one, ["house", "k"], ["x"]).select("house", "k", F.round("total", 6).alias("total"), "x")


@query("j3_issue_anti", "select count(*) as n, count(distinct event_id) as ids from events e where not exists (select 1 from events i where i.event_id % 50 = 0 and i.user_id % 4 = e.user_id % 4 and i.ts = e.ts)")
def j3(spark, sf):
    rows = readings(spark, sf).withColumn("issue", (F.col("event_id") % 50 == 0).cast("int"))
    return J.drop_issue_rows(rows, "issue", ["house", "ts"]).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("j4_label_lookup", "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def j4(spark, sf):
    nations = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j5_pred_vs_truth", upto("w") + "select house, appliance, win, step, x as truth, case when win % 3 <> 0 then x end as prediction from w")
def j5(spark, sf):
    truth = windows(spark, sf)
    pred = truth.where("win % 3 <> 0").select(*KEYS, "win", "step", F.col("x").alias("prediction"))
    return truth.join(pred, [*KEYS, "win", "step"], "left").select(*KEYS, "win", "step", F.col("x").alias("truth"), "prediction")


@query("j7_outer_sum", "with m as (select user_id % 4 as house, user_id % 2 as meter, cast(floor(epoch(ts) / 3600) as bigint) as k, cast(sum(cast(value as decimal(18,2))) as double) as x from events group by all), a as (select * from m where meter = 0), b as (select * from m where meter = 1) select coalesce(a.house, b.house) as house, coalesce(a.k, b.k) as k, round(coalesce(a.x, 0) + coalesce(b.x, 0), 2) as x from a full join b on a.house = b.house and a.k = b.k")
def j7(spark, sf):
    sums = readings(spark, sf).groupBy("house", (F.col("user_id") % 2).alias("meter"), F.floor(N.seconds("ts") / HOUR).alias("k")).agg(F.sum(F.col("watts").cast("decimal(18,2)")).cast("double").alias("x"))
    return R.sum_meters(sums, ["house"]).select("house", "k", F.round("x", 2).alias("x"))


# --- state -----------------------------------------------------------------------------------------


@query("a1_status_runs", upto("b0", "e as (select *, case when lag(raw) over (partition by house, appliance order by k) is distinct from raw then 1 else 0 end as edge from b0), n as (select *, sum(edge) over (partition by house, appliance order by k) as run from e where true)") + "select house, appliance, min(k) as run_start, max(k) + 1 as run_end, count(*) as steps from n where raw = 1 group by house, appliance, run")
def a1(spark, sf):
    return S.runs_of(filled(spark, sf).withColumn("raw", N.threshold_status("x", LOW, HIGH)), KEYS, size=48)


@query("a2_merge_short_off", upto("b2") + "select house, appliance, k, cast(c as integer) as status from b2")
def a2(spark, sf):
    return S.merge_short_off(filled(spark, sf).withColumn("raw", N.threshold_status("x", LOW, HIGH)), KEYS, 2).select(*KEYS, "k", "status")


def _after(least: int) -> str:
    return upto("b4") + f"select house, appliance, k, cast(case when c = 1 and count(*) over (partition by house, appliance, run) >= {least} then 1 else 0 end as integer) as status from b4"


@query("a3_drop_short_on", _after(3))
def a3(spark, sf):
    merged = S.merge_short_off(filled(spark, sf).withColumn("raw", N.threshold_status("x", LOW, HIGH)), KEYS, 2)
    return S.keep_long_on(merged, KEYS, 3).select(*KEYS, "k", "status")


@query("a4_min_activation", _after(4))
def a4(spark, sf):
    return S.status(filled(spark, sf).withColumn("raw", N.threshold_status("x", LOW, HIGH)), KEYS, 2, 2, 4).select(*KEYS, "k", "status")


@query("a5_paint_status", upto("st") + "select house, appliance, k, x, cast(raw as integer) as raw, status from st")
def a5(spark, sf):
    return states(spark, sf).select(*KEYS, "k", "x", "raw", "status")


@query("a5_status_in_chunks", upto("st") + "select house, appliance, k, status from st")
def a5_chunks(spark, sf):
    raw = filled(spark, sf).withColumn("raw", N.threshold_status("x", LOW, HIGH))
    return R.in_chunks(raw, KEYS, 120, 24, lambda df, keys: S.status(df, keys, 2, 2, 1)).select(*KEYS, "k", "status")


_A6 = upto("st", "e as (select *, case when lag(status) over (partition by house, appliance order by k) is distinct from status then 1 else 0 end as edge from st), n as (select *, sum(edge) over (partition by house, appliance order by k) as run from e)")


@query("a6_activations", _A6 + "select house, appliance, min(k) as start_k, max(k) + 1 as end_k, count(*) as steps, round(sum(coalesce(x, 0)), 4) as energy from n where status = 1 group by house, appliance, run")
def a6(spark, sf):
    return S.activations(states(spark, sf), KEYS, size=48).withColumn("energy", F.round("energy", 4))


@query("a7_window_has_on", upto("w") + "select house, appliance, win, max(cast(status > 0 as integer)) as label from w group by 1, 2, 3")
def a7(spark, sf):
    return W.has_on(windows(spark, sf), KEYS)


def flagship(spark, sf) -> DataFrame:
    """Activations per channel on a 6 hour grid: readings to a dense grid, gaps filled, state by rules, runs summed."""
    six = R.resample_mean(readings(spark, sf), KEYS, 6 * HOUR, digits=2)
    full = R.forward_fill(R.fill_long_gaps_zero(six, KEYS, 12), KEYS, 6).withColumn("raw", N.threshold_status("x", LOW, HIGH))
    return S.activations(S.status(full, KEYS, 1, 2, 1), KEYS)


# --- windows ---------------------------------------------------------------------------------------


@query("w1_tumbling_windows", upto("w") + "select house, appliance, win, step, k, x, status from w")
def w1(spark, sf):
    return windows(spark, sf)


_W2 = upto("st", "p0 as (select *, row_number() over (partition by house, appliance order by k) - 1 as pos, count(*) over (partition by house, appliance) as len from st), s0 as (select house, appliance, len, unnest(range(0, case when len >= 24 then 1 + (len - 24) // 6 else 0 end)) as win from (select distinct house, appliance, len from p0))")


@query("w2_sliding_windows", _W2 + "select house, appliance, win, cast(pos - win * 6 as bigint) as step, k, x, status from s0 join p0 using (house, appliance) where pos between win * 6 and win * 6 + 23")
def w2(spark, sf):
    return windows(spark, sf, 6)


@query("w3_drop_gappy_windows", upto("w") + "select house, appliance, win, step, k, x from (select *, sum(cast(x is null as integer)) over (partition by house, appliance, win) as gaps from w) where gaps = 0")
def w3(spark, sf):
    return W.drop_gappy(windows(spark, sf), KEYS, ["x"]).select(*KEYS, "win", "step", "k", "x")


@query("w4_named_sizes", upto("g", "p as (select house, appliance, k, row_number() over (partition by house, appliance order by k) - 1 as pos from g), v as (select house, appliance, cast(pos // 144 as bigint) as win, count(*) as n from p group by 1, 2, 3)") + "select house, appliance, win, n from v where n = 144")
def w4(spark, sf):
    return W.cut(grid(spark, sf), KEYS, W.window_size("day", "10min"), dense=True).groupBy(*KEYS, "win").agg(F.count("*").alias("n"))


@query("w5_window_start", upto("w") + "select house, appliance, win, timestamp '1970-01-01' + to_seconds(min(k) * 3600) as start_ts from w group by 1, 2, 3")
def w5(spark, sf):
    return windows(spark, sf).groupBy(*KEYS, "win").agg(N.from_seconds(F.min("k") * HOUR).alias("start_ts"))


@query("w6_pack_windows", upto("w") + "select house, appliance, win, min(k) over (partition by house, appliance, win) as start_k, step, x, status from w")
def w6(spark, sf):
    packed = W.pack(windows(spark, sf), KEYS, ["x", "status"])
    return W.unpack(packed, KEYS, ["x", "status"]).withColumn("step", F.col("step").cast("long"))


@query("w7_window_energy", upto("w") + "select house, appliance, win, round(sum(x), 4) as energy from w group by 1, 2, 3")
def w7(spark, sf):
    return W.energy(windows(spark, sf), KEYS).withColumn("energy", F.round("energy", 4))


@query("w8_concat_houses", upto("w") + "select house, appliance, win, min(k) as start_k, count(*) as steps, round(sum(x), 4) as total from w group by 1, 2, 3")
def w8(spark, sf):
    # windows of even houses and of odd ones, packed on their own and put together
    rows = windows(spark, sf)
    packed = [W.pack(rows.where(F.col("house") % 2 == i), KEYS, ["x"]) for i in (0, 1)]
    both = packed[0].unionByName(packed[1])
    some = F.filter("x", lambda v: v.isNotNull())
    total = F.when(F.size(some) > 0, F.round(F.aggregate(some, F.lit(0.0), lambda a, v: a + v), 4))
    return both.select(*KEYS, "win", "start_k", F.size("x").cast("long").alias("steps"), total.alias("total"))


@query("w9_basis_projection", upto("f", "h as (select house, appliance, k, coalesce(x, 0) as x from f)") + "select house, appliance, k, round(0.5 * x + 0.3 * coalesce(lead(x, 1) over o, 0) + 0.2 * coalesce(lead(x, 2) over o, 0), 7) as b0, round(x - 2 * coalesce(lead(x, 1) over o, 0) + coalesce(lead(x, 2) over o, 0), 7) as b1 from h window o as (partition by house, appliance order by k)")
def w9(spark, sf):
    made = W.basis_projection(filled(spark, sf).fillna(0.0, ["x"]), KEYS, [[0.5, 0.3, 0.2], [1.0, -2.0, 1.0]])
    return made.select(*KEYS, "k", F.round("b0", 7).alias("b0"), F.round("b1", 7).alias("b1"))


# --- sources and sinks: written by Spark from the given tables, read back by the scans --------------

_DIM = "d as (select appliance, cast(row_number() over (order by appliance) as integer) as channel from (select distinct appliance from r))"


def _channels(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    names = readings(spark, sf).select("appliance").distinct()
    return names.withColumn("channel", F.row_number().over(Window.orderBy("appliance")))


def _written_channels(spark, sf) -> str:
    path = scratch(spark)
    rows = readings(spark, sf).join(_channels(spark, sf), "appliance")
    rows.select("house", "channel", N.seconds("ts").alias("epoch_s"), "watts").write.partitionBy("house", "channel").option("sep", " ").csv(path)
    return path


@query("s1_scan_channel_files", upto("r", _DIM) + "select cast(house as integer) as house, channel, date_trunc('second', ts) as ts, watts from r join d using (appliance)")
def s1(spark, sf):
    rows = IN.channel_files(spark, _written_channels(spark, sf), r"house=(\d+)", r"channel=(\d+)")
    return rows.withColumn("ts", N.from_seconds(F.unix_seconds("ts")))


@query("s2_scan_channel_labels", upto("r", _DIM) + "select h.house, min(d.channel) as channel, d.appliance from (select distinct cast(house as integer) as house from r) h cross join d group by 1, 3")
def s2(spark, sf):
    path = scratch(spark)
    names = _channels(spark, sf)
    doubled = names.unionByName(names.withColumn("channel", F.col("channel") + 100))
    houses = readings(spark, sf).select("house").distinct()
    houses.crossJoin(doubled).select("house", "channel", "appliance").write.partitionBy("house").option("sep", " ").csv(path)
    return IN.channel_labels(spark, path, r"house=(\d+)")


#: Every channel of the given readings, in the order of the wide files' columns.
ALL = ["click", "error", "purchase", "signup", "view"]
_WIDE = " or ".join(f"o.i = {i} and appliance = '{a}'" for i, a in enumerate(ALL))


def written_houses(spark, sf) -> str:
    """Wide files of all channels, one folder a house."""
    path = scratch(spark)
    means = R.bucket_means(readings(spark, sf), KEYS, HOUR, digits=2)
    wide = J.select_channels(means.withColumn("status", F.lit(0)), ALL, ["house", "k"])
    time = F.date_format(N.from_seconds(F.col("k") * HOUR), "yyyy-MM-dd HH:mm:ss")
    values = [F.round(f"{a}_power", 6).alias(f"Appliance{i + 1}") for i, a in enumerate(ALL)]
    wide.select("house", time.alias("Time"), (F.col("k") * HOUR).alias("Unix"), *values, F.lit(0).alias("Issues")).write.partitionBy("house").option("header", True).csv(path)
    return path


@query("s3_scan_wide_house", upto("m") + f"select cast(house as integer) as house, cast(o.i as integer) as ordinal, timestamp '1970-01-01' + to_seconds(k * 3600) as ts, round(max(case when {_WIDE} then x end), 6) as watts from m cross join (select unnest(range({len(ALL)})) as i) o group by 1, 2, 3, k")
def s3(spark, sf):
    rows = IN.wide_house(spark, written_houses(spark, sf), r"house=(\d+)")
    return rows.select("house", "ordinal", F.col("ts").cast("timestamp_ntz").alias("ts"), "watts")


@query("s4_scan_meter_tables", "select cast(user_id % 4 as integer) as house, cast(user_id % 2 as integer) as meter, ts, value as watts from events")
def s4(spark, sf):
    path = scratch(spark)
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    readings(spark, sf).select(F.col("house").cast("int").alias("house"), (F.col("user_id") % 2).cast("int").alias("meter"), (micros * 1000).alias("index_ns"), F.col("watts").alias("power")).write.parquet(path)
    rows = IN.meter_tables(spark, path)
    back = F.timestamp_add("MICROSECOND", F.unix_micros("ts"), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return rows.select("house", "meter", back.alias("ts"), "watts")


@query("s5_meter_map", "with h as (select distinct user_id % 4 as house from events), a as (select distinct event_type as appliance from events) select house, appliance, case when not (house = 3 and appliance = 'view') then unnest([0, 1]) end as meter from h cross join a where not (house = 3 and appliance = 'view') union all select 3, 'view', null where exists (select 1 from h where house = 3)")
def s5(spark, sf):
    rows = readings(spark, sf)
    present = rows.select("house", "appliance").distinct().where("not (house = 3 and appliance = 'view')").withColumn("meters", F.array(F.lit(0), F.lit(1)))
    return IN.meter_map(rows, present)


@query("s6_get_house_data", upto("g") + "select appliance, k, x from g where house = 0")
def s6(spark, sf):
    return IN.house(grid(spark, sf), 0).select("appliance", "k", "x")


_S7 = upto("w", "t as (select house, win, step, min(k) as k, sum(coalesce(x, 0)) as agg, max(case when appliance = 'purchase' then x end) as app, max(case when appliance = 'purchase' then status end) as st from w group by 1, 2, 3)")


def _long(spark, sf) -> DataFrame:
    one = windows(spark, sf).groupBy("house", "win", "step").agg(F.min("k").alias("k"), F.sum(F.coalesce("x", F.lit(0.0))).alias("agg_power"), F.max(F.when(F.col("appliance") == "purchase", F.col("x"))).alias("app_power"), F.max(F.when(F.col("appliance") == "purchase", F.col("status"))).alias("app_state"))
    one = one.withColumn("agg_state", N.aggregate_state("agg_power"))
    return W.pack(one, ["house"], ["agg_power", "agg_state", "app_power", "app_state"])


@query("s7_write_long_windows", _S7 + "select win as window_idx, step as timestep, house as house_id, min(k) over (partition by house, win) as start_date, round(agg, 4) as agg_power, cast(agg > 0 as integer) as agg_state, round(app, 4) as app_power, st as app_state from t")
def s7(spark, sf):
    path = scratch(spark)
    OUT.write_by_split(OUT.long_windows(_long(spark, sf)).withColumn("split", F.when(F.col("window_idx") % 5 == 0, "test").otherwise("train")), path)
    back = spark.read.parquet(path)
    return back.select("window_idx", F.col("timestep").cast("long").alias("timestep"), "house_id", "start_date", F.round("agg_power", 4).alias("agg_power"), "agg_state", F.round("app_power", 4).alias("app_power"), "app_state")


_SW = upto("w", "i as (select appliance, case when house = 3 then 'test' when house = 2 then 'valid' else 'train' end as split, house * 100000 + win as idx, max(cast(status = 1 as integer)) as \"on\" from w group by 1, 2, 3)")


def _split_windows(spark, sf) -> DataFrame:
    split = F.when(F.col("house") == 3, "test").when(F.col("house") == 2, "valid").otherwise("train")
    return windows(spark, sf).groupBy("appliance", split.alias("split"), (F.col("house") * 100000 + F.col("win")).alias("idx")).agg(F.max((F.col("status") == 1).cast("int")).alias("on"), F.array_sort(F.collect_list("status")).alias("state"))


@query("s8_export_splits", _SW + "select appliance, split, idx, \"on\" from (select *, row_number() over (partition by appliance, split order by idx) as rn from i) where rn <= 10")
def s8(spark, sf):
    from meterlake.operators.splits import cap_samples

    path = scratch(spark)
    OUT.write_by_split(cap_samples(_split_windows(spark, sf), ["appliance", "split"], "idx", 10).select("appliance", "split", "idx", "on"), path)
    return spark.read.parquet(path)


@query("s9_export_on_index", _SW + "select appliance, split, idx from i where \"on\" = 1")
def s9(spark, sf):
    made = _split_windows(spark, sf)
    return made.where(F.exists("state", lambda s: s == 1)).select("appliance", "split", "idx")


@query("s10_export_split_summary", _SW + "select appliance, " + ", ".join(f"count(*) filter (split = '{s}') as {s}_n, count(*) filter (split = '{s}' and idx % 2 = 0) as {s}_written, count(*) filter (split = '{s}' and \"on\" = 1) as {s}_on, round(100.0 * count(*) filter (split = '{s}' and \"on\" = 1) / count(*) filter (split = '{s}'), 4) as {s}_pct_on" for s in ("train", "valid", "test")) + " from i group by 1")
def s10(spark, sf):
    made = _split_windows(spark, sf)
    out = OUT.split_summary(made, made.where("idx % 2 = 0"), ["train", "valid", "test"])
    return out.select(*(F.round(c, 4).alias(c) if c.endswith("pct_on") else F.col(c) for c in out.columns))


@query("s11_write_eval_samples", upto("w") + "select house, appliance, win, step, x, case when win % 2 = 0 then round(x * 2, 6) end as synth_x from w")
def s11(spark, sf):
    real = windows(spark, sf).select(*KEYS, "win", "step", "x")
    synthetic = real.where("win % 2 = 0").withColumn("x", F.round(F.col("x") * 2, 6))
    path = scratch(spark)
    OUT.eval_samples(real, synthetic, [*KEYS, "win", "step"], ["x"]).write.parquet(path)
    return spark.read.parquet(path)


@query("s12_write_predictions", upto("g", "p as (select house, appliance, row_number() over (partition by house, appliance order by k) - 1 as pos, x as prediction from g)") + f"select house, appliance, cast(pos // {SIZE} as bigint) as window_idx, cast(pos % {SIZE} as bigint) as timestep, prediction from p")
def s12(spark, sf):
    flat = W.positions(grid(spark, sf), KEYS).withColumnRenamed("x", "prediction")
    path = scratch(spark)
    OUT.prediction_windows(flat, KEYS, SIZE).write.parquet(path)
    return spark.read.parquet(path)


_RUNS = "runs as (select o_custkey % 7 as model, o_orderpriority as dataset, o_orderstatus as appliance, o_orderkey % 3 as seed, o_orderkey, cast(o_totalprice as double) as mae from orders)"


def run_logs(spark, sf) -> DataFrame:
    """Orders as run logs."""
    price = F.col("o_totalprice").cast("double")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("model"), F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("appliance"), (F.col("o_orderkey") % 3).alias("seed"), "o_orderkey", price.alias("mae"))


@query("s13_scan_runs", "select cast(o_custkey % 7 as varchar) as model, cast(o_orderkey % 3 as integer) as seed, cast(o_orderkey as integer) as window, cast(o_totalprice as double) as mae, cast(null as double) as f1 from orders")
def s13(spark, sf):
    path = scratch(spark)
    logs = run_logs(spark, sf).select(F.col("model").cast("string").alias("model"), F.col("seed").cast("int").alias("seed"), F.col("o_orderkey").cast("int").alias("window"), F.create_map(F.lit("mae"), "mae").alias("metrics"))
    logs.write.json(f"{path}/a/b")
    return OUT.scan_runs(spark, path, ["mae", "f1"]).select("model", "seed", "window", "mae", "f1")


@query("s14_append_timing", "select 'count of ' || event_type as experiment, cast(n as double) as train_time, 0.0 as eval_time from (select event_type, count(*) as n from events group by 1)")
def s14(spark, sf):
    path = scratch(spark)
    counts = table(spark, sf, "events").groupBy("event_type").count()
    for kind in ("c", "e"):
        # two runs of experiments, one after the other
        own = counts.where(F.col("event_type").startswith(kind) if kind == "c" else ~F.col("event_type").startswith("c"))
        OUT.append_timings(own.select(F.concat(F.lit("count of "), "event_type").alias("experiment"), F.col("count").alias("train_time"), F.lit(0.0).alias("eval_time")), path)
    return spark.read.option("header", True).schema("experiment string, train_time double, eval_time double").csv(path)


@query("s15_write_metrics_table", f"with {_RUNS} select cast(model as integer) as model, dataset, round_even(avg(mae), 3) as mae from runs group by 1, 2")
def s15(spark, sf):
    from meterlake.operators.runs import fold_average

    path = scratch(spark)
    OUT.write_metrics_table(fold_average(run_logs(spark, sf), ["model", "dataset"], ["mae"]), path, ["model", "dataset"])
    return spark.read.option("header", True).schema("model int, dataset string, mae double").csv(path)


@query("s16_scan_split_summary", _SW + "select split, count(*) as n, cast(sum(o) as bigint) as n_on, round(100.0 * sum(o) / count(*), 4) as pct_on from (select split, idx, max(\"on\") as o from i group by 1, 2) group by 1")
def s16(spark, sf):
    steps = _split_windows(spark, sf).select("split", "idx", F.col("on").alias("status"))
    return OUT.read_summary(spark, scratch(spark), steps).withColumn("pct_on", F.round("pct_on", 4))


@query("s16_scan_written_summary", _SW + "select split, count(*) as n, cast(sum(o) as bigint) as n_on, round(100.0 * sum(o) / count(*), 4) as pct_on from (select split, idx, max(\"on\") as o from i group by 1, 2) group by 1")
def s16_written(spark, sf):
    path = scratch(spark)
    steps = _split_windows(spark, sf).select("split", "idx", F.col("on").alias("status"))
    OUT.read_summary(spark, path, steps).write.option("header", True).csv(path)
    return OUT.read_summary(spark, path, steps).withColumn("pct_on", F.round("pct_on", 4))
