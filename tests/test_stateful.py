"""Stateful operators on file streams against the batch operators over the same rows."""

import random
import tempfile

import pytest
from pyspark.sql import Window, functions as F

from meterlake.operators import regularise as R, status as S
from meterlake.streaming import stateful as T

STORE = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "house string, channel int, id string, second long, watts double"


@pytest.fixture(scope="module")
def stores(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


def streamed(spark, batches, made):
    """What a stream gives that reads one file of rows per micro-batch."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withColumn("ts", F.timestamp_seconds("second"))
    run = made(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert run.awaitTermination(200)
    return spark.read.parquet(f"{folder}/out")


def loop(rules, means):
    """Rows of one series in one go, with what is left at its end."""
    series = T.Series(rules)
    for k, x in means:
        series.add(k, x)
    series.settle()
    return series.done


def test_series_against_batch(spark):
    rng, rules, rows = random.Random(9), T.SeriesRules(every=1, long_gap=5, fill=2, low=5, high=90, min_on=3, min_off=2, min_activation=2), []
    for h in range(25):
        k = rng.randint(-5, 5)
        for _ in range(rng.randint(1, 60)):
            rows.append((h, k, float(rng.choice([0, 1, 7, 50, 95]))))
            k += rng.choice([1, 1, 1, 2, 3, 4, 7, 12])
    means = spark.createDataFrame(rows, "h int, k long, x double")
    full = R.forward_fill(R.fill_long_gaps_zero(R.dense(means, ["h"]), ["h"], 5), ["h"], 2)
    raw = full.withColumn("raw", F.coalesce(F.col("x").between(5, 90), F.lit(False)).cast("int"))
    expect = sorted(tuple(r) for r in S.status(raw, ["h"], 3, 2, 2).select("h", "k", "x", "raw", "status").collect())
    got = sorted((h, *r) for h in range(25) for r in loop(rules, [(k, x) for g, k, x in rows if g == h]))
    assert [tuple(str(v) for v in r) for r in got] == [tuple(str(v) for v in r) for r in expect]


def test_states_on_a_stream(spark, stores):
    """Three micro-batches with late rows, and a last one that moves the watermark: what leaves is what the batch gives."""
    rng, rules = random.Random(4), T.SeriesRules(every=10, long_gap=4, fill=2, low=5, high=500, min_on=3, min_off=2)
    batches = [[], [], []]
    for house in ("a", "b", "c"):
        second = 1000
        for i in range(150):
            row = (house, 1, f"{house}{i}", second, float(rng.choice([0, 3, 20, 300])))
            at = min(2, i // 50)
            # some come a micro-batch late, within the bound
            batches[min(2, at + (rng.random() < 0.2 and i % 50 > 40))].append(row)
            second += rng.choice([3, 8, 10, 10, 25, 40, 90])
    for rows in batches:
        rng.shuffle(rows)
    every = [r for rows in batches for r in rows]
    too_late = ("a", 1, "x", 1001, 400.0)
    end = max(r[3] for r in every)
    found = streamed(spark, [*batches, [too_late, ("z", 1, "z", end + 20_000, 1.0)], [("z", 1, "y", end + 40_000, 1.0)]], lambda s: T.states(s, ["house", "channel"], rules, late="1500 seconds"))
    keys = ["house", "channel"]
    means = R.bucket_means(spark.createDataFrame(every, SCHEMA).withColumn("ts", F.timestamp_seconds("second")), keys, 10)
    full = R.forward_fill(R.fill_long_gaps_zero(R.dense(means, keys), keys, 4), keys, 2)
    raw = full.withColumn("raw", F.coalesce(F.col("x").between(5, 500), F.lit(False)).cast("int"))
    rows = lambda df: sorted((r["house"], r["channel"], r["k"], None if r["x"] is None or r["x"] != r["x"] else round(r["x"], 6), r["raw"], r["status"]) for r in df.where("house <> 'z'").collect())
    got, expect = rows(found), rows(S.status(raw, keys, 3, 2, 0))
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in expect] and len(got) > 300


def test_corrections_on_a_stream(spark, stores):
    first = [("a", 1, "1", 100, 1.0), ("a", 1, "2", 105, 3.0), ("a", 1, "2", 105, 3.0), ("b", 2, "9", 100, 5.0), ("a", 1, None, 100, 9.0)]
    second = [("a", 1, "1", 100, 1.0), ("a", 1, "3", 101, 8.0), ("a", 1, "4", 300, 2.0)]
    # within the bound for its bucket; then the watermark passes all of them, and a row beyond it is dropped
    third = [("a", 1, "5", 250, 6.0), ("b", 2, "10", 1000, 7.0)]
    fourth = [("a", 1, "6", 102, 50.0), ("b", 2, "9", 100, 5.0), ("b", 2, "11", 1001, 9.0)]
    found = streamed(spark, [first, second, third, fourth, [("b", 2, "12", 5000, 1.0)]], lambda s: T.corrected_means(s, ["house", "channel"], "id", every=10, late="300 seconds"))
    got = sorted(tuple(r[c] for c in ("house", "k", "x", "readings", "revision")) for r in found.collect())
    assert got == [("a", 10, 2.0, 2, 1), ("a", 10, 4.0, 3, 2), ("a", 25, 6.0, 1, 1), ("a", 30, 2.0, 1, 1), ("b", 10, 5.0, 1, 1), ("b", 100, 7.0, 1, 1), ("b", 100, 8.0, 2, 2), ("b", 500, 1.0, 1, 1)]
    last = found.withColumn("n", F.row_number().over(Window.partitionBy("house", "k").orderBy(F.desc("revision")))).where("n = 1")
    assert last.count() == 6
