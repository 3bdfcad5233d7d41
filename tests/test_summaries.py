"""Summaries against exact figures, exact quantiles on a hot key, window cutting from SQL."""

import math
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from meterlake.functions import table_functions
from meterlake.operators import segments, summaries as Y, windows as W


def test_merged_days_equal_the_whole_within_the_bound(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("house"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 30).alias("ts"), F.exp(F.rand(5) * 8).alias("watts"))
    rows = rows.unionByName(spark.createDataFrame([(0, None, float("nan"))], "house long, ts timestamp, watts double")).cache()
    days = Y.summarise(rows, ["house"])
    assert days.count() > 50 and max(len(r["values"]) for r in days.collect()) < 20_000
    good = rows.where("not isnan(watts)")
    for last in ("2023-11-25", "2100-01-01"):
        own = good.where(F.to_date("ts") < last)
        found = {r["house"]: r for r in Y.merge(days.where(F.col("period") < last), ["house"]).select("*", *(Y.quantile(q).alias(f"q{i}") for i, q in enumerate((0.05, 0.5, 0.95))), Y.distinct_times().alias("d")).collect()}
        for house in range(3):
            values = sorted(r["watts"] for r in own.where(F.col("house") == house).collect())
            r = found[house]
            assert (r["n"], r["low"], r["high"]) == (len(values), values[0], values[-1]) and r["total"] == pytest.approx(sum(values))
            for i, q in enumerate((0.05, 0.5, 0.95)):
                rank = sum(v <= r[f"q{i}"] for v in values) / len(values)
                assert abs(rank - q) < 0.015
            assert abs(r["d"] / len(values) - 1) < 0.03
    floors = {r["house"]: r["floor"] for r in Y.noise_floors(days, ["house"]).collect()}
    exact = {r["house"]: r["x"] for r in Y.exact_quantiles(good, ["house"], "watts", [0.1], limit=500).collect()}
    assert all(abs(math.log(floors[h] / exact[h])) < 0.2 for h in exact)
    scales = {r["house"]: r for r in Y.robust_scales(days, ["house"]).collect()}
    fitted = {r["house"]: r for r in Y.fit_robust(good, ["house"], "watts", limit=500).collect()}
    assert all(scales[h][c] == pytest.approx(fitted[h][c], rel=0.15) for h in fitted for c in ("stat1", "stat2"))
    rows.unpersist()


def expect(values, q):
    n = len(values)
    return sorted(values)[max(1, n - math.floor(n - q * n)) - 1]


def test_exact_quantiles_of_a_hot_key(spark):
    """One channel has 90 % of all rows, half of them one value; others are tiny, null or crowded in a narrow range."""
    rng = random.Random(3)
    rows = [("hot", rng.choice([7.0, rng.random() * 100])) for _ in range(9000)] + [("one", 3.0)] + [(None, float(i)) for i in range(20)]
    rows += [("narrow", 1e6 + rng.random() * 1e-6) for _ in range(900)] + [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300)) for _ in range(80)] + [("none", None), ("nan", float("nan")), ("hot", None)]
    df = spark.createDataFrame(rows, "c string, x double").repartition(6)
    qs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    own = {}
    for c, x in rows:
        if x is not None and x == x:
            own.setdefault(c, []).append(x)
    for limit in (1, 40, 10**6):
        found = {(r["c"], r["q"]): (r["n"], r["x"]) for r in Y.exact_quantiles(df, ["c"], "x", qs, limit).collect()}
        assert found == {(c, q): (len(v), expect(v, q)) for c, v in own.items() for q in qs}
    assert Y.exact_quantiles(df.limit(0), ["c"], "x", qs).collect() == []
    whole = Y.exact_quantiles(df.where("c = 'hot'"), [], "x", [0.5], 10).first()
    assert whole["x"] == expect(own["hot"], 0.5)


def test_cut_windows_from_sql(spark):
    table_functions.register(spark)
    rows = spark.createDataFrame([(h, k, None if k % 11 == 5 else float(k)) for h in "ab" for k in range(40 if h == "a" else 9)], "h string, k long, x double")
    rows.createOrReplaceTempView("rows_of_windows")
    for size, stride in ((5, 5), (6, 2), (4, 9)):
        found = spark.sql(f"select h, win, step, k, x from cut_windows(rows => table(rows_of_windows) partition by h order by k, size => {size}, stride => {stride})")
        told = W.cut(segments.positions(rows, ["h"]), ["h"], size, stride).where(F.col("step") < size).select("h", "win", "step", "k", "x")
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, told.collect()), key=str)
    gaps = spark.sql("select distinct h, win from cut_windows(rows => table(rows_of_windows) partition by h order by k, size => 5, whole => 'x')").collect()
    # missing at 5, 16, 27 and 38
    assert sorted(map(tuple, gaps)) == [("a", 0), ("a", 2), ("a", 4), ("a", 6), ("b", 0)]
    with pytest.raises(AnalysisException, match="whole number"):
        spark.sql("select * from cut_windows(rows => table(rows_of_windows) partition by h order by k, size => 0)").collect()
