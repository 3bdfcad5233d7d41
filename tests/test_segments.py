"""Runs, places and carried values by segments, against windows over whole series and plain loops."""

import random

import pytest
from pyspark.sql import Window, functions as F

from meterlake.operators import evaluate, ordered, regularise, segments as G, status, windows as W


def series(spark, holes: bool, seed: int = 5):
    """Series with runs that last for many segments of 7 buckets, some of them beginning below zero."""
    rng, rows = random.Random(seed), []
    for h in range(6):
        k, state = rng.randint(-40, 40), 0
        for _ in range(rng.randint(1, 12)):
            state = rng.choice([0, 1, None]) if h % 2 else 1 - (state or 0)
            for _ in range(rng.choice([1, 2, 6, 7, 8, 30, 60])):
                rows.append((h, k, state, float(rng.randint(0, 99)) if rng.random() < 0.3 else None))
                k += rng.choice([1, 1, 1, 9]) if holes else 1
    return spark.createDataFrame(rows, "h int, k long, s int, x double").repartition(5)


def same(a, b):
    key = lambda r: tuple(str(v) for v in r)
    got, expect = sorted(map(tuple, a.collect()), key=key), sorted(map(tuple, b.collect()), key=key)
    assert got == expect and got


@pytest.mark.parametrize("holes", [False, True])
def test_runs_and_places(spark, holes):
    rows = series(spark, holes).cache()
    by_run = regularise.run_ids(rows, ["h"], F.col("s"))
    same(G.run_ids(rows, ["h"], F.col("s"), size=7), by_run)
    size = F.count("*").over(Window.partitionBy("h", "run")).alias("size")
    same(G.run_sizes(rows, ["h"], F.col("s"), size=7), by_run.select("h", "k", "s", "x", size))
    whole = by_run.where("s = 1").groupBy("h", "run").agg(F.min("k").alias("start"), (F.max("k") + 1).alias("end"), F.count("*").alias("steps"), F.sum("x").alias("e")).drop("run")
    same(G.runs(rows, ["h"], F.col("s"), {"e": F.col("x")}, size=7), whole)
    w = Window.partitionBy("h").orderBy("k")
    places = rows.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    same(G.positions(rows, ["h"], size=7), places)
    same(G.carry_last(rows, ["h"], {"last": "x"}, size=7), rows.withColumn("last", F.last("x", ignorenulls=True).over(w)))
    for size, stride in ((5, 5), (5, 2), (3, 7)):
        cut = W.cut(places, ["h"], size, stride)
        if not holes:
            same(W.cut(rows, ["h"], size, stride, dense=True).select(sorted(cut.columns)), cut.select(sorted(cut.columns)).where("step < %d" % size))
    same(W.decimate(rows, ["h"], 10), W.decimate(rows, ["h"], 10, dense=True)) if not holes else None
    rows.unpersist()


def test_a_run_over_many_segments_is_whole(spark):
    rows = spark.range(100_000).select(F.lit("a").alias("h"), F.col("id").alias("k"), (F.col("id") != 50_000).cast("int").alias("raw"))
    found = sorted(map(tuple, status.runs_of(rows, ["h"], size=100).collect()))
    assert found == [("a", 0, 50_000, 50_000), ("a", 50_001, 100_000, 49_999)]
    assert status.runs_of(rows.limit(0), ["h"]).count() == 0


def test_no_window_over_a_series(spark):
    rows = spark.range(1000).select(F.lit("a").alias("h"), F.col("id").alias("k"), F.lit(1).alias("raw"))
    for made in (status.runs_of(rows, ["h"], size=100), G.positions(rows, ["h"], size=100)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        # what is ordered by k is ordered within a segment
        assert all("__segment" in line.split("[k#")[0] for line in plan.splitlines() if line.strip().strip("+-: ").startswith("Window") and "[k#" in line)
    assert "Window" not in W.cut(rows, ["h"], 24, dense=True)._jdf.queryExecution().optimizedPlan().toString()


def test_value_ranges_follow_the_order(spark):
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    values = [rng.random() for _ in range(300)] + [5 + rng.random() * 1e-6 for _ in range(3000)] + [1e300, -1e300, inf, -inf, nan, 5.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = [(r["v"], r["value_range"]) for r in ordered.value_ranges(rows, "v").orderBy("v").collect()]
    places = [p for _, p in found]
    assert places == sorted(places) and len(found) == len(values)
    down = [r["value_range"] for r in ordered.value_ranges(rows, "v", descending=True).orderBy(F.desc("v")).collect()]
    assert down == sorted(down)
    crowded = ordered.value_ranges(rows.where("v between 0 and 10"), "v").groupBy("value_range").count().agg(F.max("count")).first()[0]
    assert crowded < 60
    assert ordered.value_ranges(rows.limit(0), "v").count() == 0


def test_ranked_metrics_start_no_job(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "score double, label int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    found = evaluate.roc_auc(rows), evaluate.average_precision(rows)
    assert tracker.getJobIdsForGroup("lazy") in ((), [])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0].first()[0] == pytest.approx(0.875) and found[1].first()[0] == pytest.approx(5 / 6)
