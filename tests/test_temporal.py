"""Joins in time against plain loops."""

import random

from pyspark.sql import functions as F

from meterlake.operators import temporal as T


def test_as_of_against_a_loop(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 5000, 7)]), rng.random()) for i in range(400)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 5000, 13)]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(150)]
    a = spark.createDataFrame(left, "i int, h string, s long, w double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    b = spark.createDataFrame(right, "h string, s long, w double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for tolerance in (None, 40):
        found = {r["i"]: (None if r["last_ts"] is None else int(r["last_ts"].timestamp()), r["last_w"]) for r in T.as_of(a, b, ["h"], ["w"], tolerance_s=tolerance, slice_s=100).collect()}
        assert len(found) == len(left)
        for i, h, s, _ in left:
            some = [(t, -1.0 if w is None else w) for g, t, w in right if h is not None and g == h and t is not None and s is not None and t <= s]
            best = max(some, default=None)
            if best and tolerance is not None and s - best[0] > tolerance:
                best = None
            assert found[i] == (None, None) if best is None else (found[i][0], -1.0 if found[i][1] is None else found[i][1]) == best


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(2)
    made = lambda n: [(i, rng.choice([1, 2, None]), (s := rng.randint(-500, 500)), s + rng.choice([0, 1, 2, 5, 30, 700, -3])) for i in range(n)]
    left, right = made(150), made(120)
    a, b = (spark.createDataFrame(x, "i int, h int, start long, end long") for x in (left, right))
    found = sorted((r["i"], r["start"], r["end"], r["r_i"], r["overlap"]) for r in T.overlaps(a, b, ["h"], bucket=4, fan=3).collect())
    expect = sorted((i, s, e, j, min(e, f) - max(s, t)) for i, h, s, e in left for j, g, t, f in right if h is not None and h == g and s < e and t < f and s < f and t < e)
    assert found == expect and found


def test_one_long_interval_and_many_short_ones(spark):
    long = spark.createDataFrame([(0, 1, 0, 1_000_000)], "i int, h int, start long, end long")
    short = spark.range(100_000).select(F.col("id").cast("int").alias("i"), F.lit(1).alias("h"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 7).alias("end"))
    assert T.overlaps(long, short, ["h"], bucket=64).agg(F.count("*"), F.sum("overlap")).first()[:] == (100_000, 700_000)
    # narrow intervals of both sides meet in narrow buckets only
    both = T.overlaps(short.unionByName(long), short, ["h"], bucket=64)
    assert both.count() == 200_000
