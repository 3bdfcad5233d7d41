"""Appends to a lake against one preparation of everything."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from meterlake.plans.profiles import Profile, Rules, prepare
from meterlake.sources import lake

PROFILE = Profile("channels", {"a": Rules(40.0, 300.0, 2, 2, 1), "b": Rules(10.0, 300.0, 3, 1, 1)}, every=1800, cutoff=400.0, factor=2)
SCHEMA = "house int, appliance string, second long, watts double"


def rows(df):
    key = lambda r: tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r)
    return sorted((key(r) for r in df.select("house", "appliance", "k", "x", "status", "total").collect()), key=str)


def readings(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("ts", F.timestamp_seconds("second")).drop("second")


def test_three_appends_one_of_them_late_equal_one_run(spark):
    rng, data = random.Random(6), []
    for house in (1, 2):
        for name in ("aggregate", "a", "b"):
            second = rng.randint(0, 90_000)
            while second < 40 * lake.DAY:
                data.append((house, name, second, float(rng.choice([0, 20, 60, 350, 900]))))
                second += rng.choice([600, 1800, 1800, 4000, 20_000] + [4 * lake.DAY] * (rng.random() < 0.02))
    # a series that is silent for weeks, so that a late row stands in the middle of a gap
    data += [(1, "b", 41 * lake.DAY + 5, 50.0), (1, "b", 60 * lake.DAY, 70.0), (1, "aggregate", 60 * lake.DAY + 10, 90.0), (1, "b", None, 1.0)]
    late = [r for r in data if r[2] is not None and 20 * lake.DAY < r[2] < 21 * lake.DAY] + [(1, "b", 50 * lake.DAY, 55.0)]
    data.append(late[-1])
    first = [r for r in data if r not in late and (r[2] is None or r[2] < 25 * lake.DAY)]
    second = [r for r in data if r not in late and r not in first]
    path = tempfile.mkdtemp(prefix="spark-")
    n = [lake.append(spark, path, f"b{i}", readings(spark, part), PROFILE) for i, part in enumerate((first, second, late))]
    assert n[2] < n[0] and lake.append(spark, path, "b2", readings(spark, late), PROFILE) == 0
    expect = rows(prepare(readings(spark, [r for r in data if r[2] is not None]), PROFILE))
    assert rows(lake.prepared(spark, path)) == expect and len(expect) > 2000
    # one day more touches few partitions of one house
    more = [(2, "a", 39 * lake.DAY + 100, 100.0)]
    assert 0 < lake.append(spark, path, "b3", readings(spark, more), PROFILE) < 15
    assert rows(lake.prepared(spark, path)) == rows(prepare(readings(spark, [r for r in data if r[2] is not None] + more), PROFILE))


def test_a_broken_append_is_made_again(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="spark-")
    data = [(1, n, s, 50.0 + s % 7) for n in ("aggregate", "a") for s in range(0, 3 * lake.DAY, 3000)]
    lake.append(spark, path, "x", readings(spark, data[::2]), PROFILE)
    with monkeypatch.context() as m:
        m.setattr(lake, "prepare", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            lake.append(spark, path, "y", readings(spark, data[1::2]), PROFILE)
    assert lake.append(spark, path, "y", readings(spark, data[1::2]), PROFILE) > 0
    assert rows(lake.prepared(spark, path)) == rows(prepare(readings(spark, data), PROFILE))
    with pytest.raises(ValueError, match="anchored"):
        lake.append(spark, path, "z", readings(spark, data), Profile("channels", {}, anchor="day"))
    with pytest.raises(ValueError, match="nothing"):
        lake.prepared(spark, path + "/none")


def test_known_profiles():
    from meterlake.plans.profiles import known_profile

    one, two, three = (known_profile(d) for d in ("ukdale", "refit", "redd"))
    assert (one.layout, two.layout, three.layout) == ("channels", "wide", "meters") and (one.cutoff, two.cutoff, three.cutoff) == (6000, 10_000, 6000)
    assert (one.fill, two.fill, two.long_gap) == (6, 9, None) and one.rules["dishwasher"] == Rules(10.0, 2500.0, 180, 180, 12)
    plain = known_profile("refit", durations=False, synthetic=True, anchor="week")
    assert plain.rules["Kettle"] == Rules(500.0, 6000.0) and not plain.use_durations and "Kettle" in plain.synthetic and plain.anchor == "week"
