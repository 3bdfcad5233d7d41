"""Operators on small literal frames, and properties of the rules."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from meterlake.functions import calendar as C, metrics as M, numeric as N
from meterlake.operators import align as J, evaluate as E, models as X, regularise as R, runs as U, scaling as K, splits as L, status as S, windows as W
from meterlake.plans.profiles import Profile, Rules, prepare
from meterlake.operators.ordered import running_sums, value_ranges
from meterlake.sources import known, readings as IN, results as OUT
from meterlake.sources.folders import shared_folder


def series(spark, values, house=1):
    return spark.createDataFrame([(house, k, v) for k, v in enumerate(values)], "house int, k long, x double")


def values(df, col="x"):
    return [r[col] for r in df.orderBy("k").collect()]


def test_forward_fill_stops_at_the_limit(spark):
    assert values(R.forward_fill(series(spark, [1.0] + [None] * 7), ["house"], 6)) == [1.0] * 7 + [None]


def test_long_gaps(spark):
    at = series(spark, [1.0] + [None] * 12 + [2.0] + [None] * 13)
    assert values(R.fill_long_gaps_zero(at, ["house"], 12)) == [1.0] + [None] * 12 + [2.0] + [0.0] * 13


def test_resample_and_long_grids(spark):
    ts = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, ts, 2.0), (1, ts + datetime.timedelta(seconds=5), 4.0), (1, ts + datetime.timedelta(seconds=31), float("nan"))], "house int, ts timestamp_ntz, watts double")
    assert values(R.resample_mean(df, ["house"], 10)) == [3.0, None, None, None]
    with pytest.raises(Exception, match="too long"):
        R.dense(R.bucket_means(df, ["house"], 10), ["house"], max_steps=2).collect()


def test_status_rules(spark):
    def run(raw, **kw):
        df = series(spark, raw).withColumn("raw", F.col("x").cast("int"))
        return values(S.status(df, ["house"], **kw), "status")

    raw = [1, 1, 0, 0, 1, 0, 0, 0, 1]
    assert run(map(float, raw), min_off=2) == [1, 1, 1, 1, 1, 0, 0, 0, 1]
    assert run(map(float, raw), min_off=2, min_on=2) == [1, 1, 1, 1, 1, 0, 0, 0, 0]
    assert run([1.0] * 5) == [1] * 5 and run([0.0] * 5) == [0] * 5


def model_status(raw, min_on, min_off, min_act):
    runs, at = [], 0
    while at < len(raw):
        end = at
        while end < len(raw) and raw[end] == raw[at]:
            end += 1
        if raw[at]:
            if runs and at - runs[-1][1] <= min_off:
                runs[-1][1] = end
            else:
                runs.append([at, end])
        at = end
    out = [0] * len(raw)
    for a, b in runs:
        if b - a >= max(min_on, min_act):
            out[a:b] = [1] * (b - a)
    return out


def test_status_against_run_lists_and_in_chunks(spark):
    rng = random.Random(1)
    cases = [[int(rng.random() < rng.choice([0.2, 0.5, 0.8])) for _ in range(rng.randint(1, 60))] for _ in range(60)]
    rows = [(i, k, float(v)) for i, raw in enumerate(cases) for k, v in enumerate(raw)]
    df = spark.createDataFrame(rows, "house int, k long, x double").withColumn("raw", F.col("x").cast("int"))
    for min_on, min_off, min_act in ((1, 0, 0), (2, 2, 1), (3, 1, 5)):
        rule = lambda d, keys: S.status(d, keys, min_on, min_off, min_act)  # noqa: B023, E731
        whole = {(r["house"], r["k"]): r["status"] for r in rule(df, ["house"]).collect()}
        assert whole == {(i, k): s for i, raw in enumerate(cases) for k, s in enumerate(model_status(raw, min_on, min_off, min_act))}
        pieces = {(r["house"], r["k"]): r["status"] for r in R.in_chunks(df, ["house"], 16, 16, rule).collect()}
        assert pieces == whole


def test_clip_and_noise(spark):
    df = series(spark, [-1.0, None, 3.0, 7000.0])
    assert values(df.withColumn("x", N.clip(N.noise_floor("x"), 6000.0))) == [0.0, None, 0.0, 6000.0]


def test_meter_sum(spark):
    df = spark.createDataFrame([(1, 0, 1, 1.0), (1, 0, 2, None), (1, 1, 1, None), (1, 1, 2, None), (1, 2, 1, 2.0), (1, 2, 2, 3.0)], "house int, k long, meter int, x double")
    assert values(R.sum_meters(df, ["house"])) == [1.0, None, 5.0]


def test_windows(spark):
    df = series(spark, [float(i) for i in range(10)])
    assert W.cut(df, ["house"], 4).select("win").distinct().count() == 2
    assert {r["win"]: r["n"] for r in W.cut(df, ["house"], 4, 2).groupBy("win").agg(F.count("*").alias("n")).collect()} == {0: 4, 1: 4, 2: 4, 3: 4}
    assert W.cut(series(spark, [1.0] * 3), ["house"], 4).count() == 0
    gappy = W.cut(series(spark, [None if i == 5 else 1.0 for i in range(10)]), ["house"], 4)
    assert [r["win"] for r in W.drop_gappy(gappy, ["house"], ["x"]).select("win").distinct().collect()] == [0]
    packed = W.pack(W.cut(df, ["house"], 4), ["house"], ["x"])
    assert [r["x"] for r in packed.orderBy("win").collect()] == [[0.0, 1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0]]
    with pytest.raises(ValueError):
        W.window_size("month", "1min")


def test_anchor(spark):
    start = datetime.datetime(2024, 1, 1, 13)
    rows = [(1, start + datetime.timedelta(hours=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "house int, ts timestamp")
    tuesday = datetime.datetime(2024, 1, 2)
    assert J.anchor(df, ["house"]).agg(F.min("ts")).first()[0] == tuesday
    assert J.anchor(df, ["house"], weekday=1).agg(F.min("ts")).first()[0] == tuesday
    assert J.anchor(df, ["house"], weekday=5).count() == 0


def test_periods(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, day(1), 2.0, 3.0, 4.0), (1, day(4), 5.0, 5.0, 9.0)], "house int, ts timestamp, y double, p double, total double")
    found = E.period_sums(df, ["house"], "day").orderBy("period").collect()
    assert [(r["y"], r["p"], r["total"]) for r in found] == [(3, 4, 5), (1, 1, 1), (1, 1, 1), (6, 6, 10)]


def test_metrics(spark):
    schema = "y double, p double, s int, q int"
    zero = E.per_step(spark.createDataFrame([(0.0, 1.0, 0, 1), (0.0, 3.0, 0, 0)], schema)).first()
    assert (zero["mae"], zero["teca"], zero["nde"], zero["sae"]) == (2.0, None, None, None)
    assert zero["balanced_accuracy"] == 0.5 and zero["precision"] == 0
    same = E.per_step(spark.createDataFrame([(1.0, 1.0, 1, 1), (2.0, 2.0, 0, 0)], schema)).first()
    assert [same[c] for c in ("mae", "teca", "nde", "sae", "mr", "f1", "f1_macro")] == [0, 1, 0, 0, 1, 1, 1]
    assert spark.range(1).select(N.half_even(F.lit(0.0625), 3).alias("x")).first()["x"] == 0.062
    ranked = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "score double, label int")
    assert E.roc_auc(ranked).first()[0] == 0.75
    assert abs(E.average_precision(ranked).first()[0] - 0.8333333) < 1e-6
    assert spark.range(1).select(M.share(F.lit(0), F.lit(0)).alias("x")).first()["x"] == 0


def test_epochs(spark):
    def curve(losses):
        return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(losses)], "run int, epoch int, loss double")

    assert U.best_epoch(curve([3, 2, 2, 4]), ["run"]).first()["epoch"] == 2
    assert U.early_stop(curve([3, 2, 2, 4, 5]), ["run"], 2).first()["epoch"] == 4
    assert U.early_stop(curve([3, 2, 2, 4]), ["run"], 2).first()["epoch"] is None


def test_scalers_invert(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0), ("b", 8.0), ("b", 3.0)], "c string, x double").withColumn("was", F.col("x"))
    for kind in [*K.Scaling, 7]:
        stats = K.fit(df, kind, "x", ["c"])
        back = K.inverse(K.transform(df, stats, "x", ["c"]), stats, "x", ["c"]).collect()
        assert all(abs(r["x"] - r["was"]) < 1e-9 for r in back)


def test_splits_are_whole(spark):
    df = spark.range(100)
    for made in (L.split_rows(df, "id", 0.2, 0.1), L.split_entities(df, "id", 0.2, 0.25), L.split_houses(df, 0, n_test=7, id_col="id"), L.split_counts(df, "id", 5, 6)):
        assert made.count() == 100 and made.select("id").distinct().count() == 100
    with pytest.raises(Exception, match="no house left"):
        L.split_houses(spark.range(2), 0, n_test=1, n_valid=1, id_col="id").collect()


def test_calendar(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 6),)], "ts timestamp")
    r = df.select(*C.cyclic("ts", ["hour", "dow"])).first()
    assert abs(r["hour_sin"] - 1) < 1e-9 and r["dow_cos"] == 1
    with pytest.raises(ValueError):
        C.field("ts", "era")
    assert df.select(*C.linear("ts", ["hour"])).first()["hour"] == -0.5


def test_sources(spark, tmp_path):
    for house, channel, text in ((1, 1, "10 1.5\n20 2\n"), (1, 2, "10 3\n"), (2, 1, "30 4\n")):
        folder = tmp_path / f"house_{house}"
        folder.mkdir(exist_ok=True)
        (folder / f"channel_{channel}.dat").write_text(text)
        (folder / "labels.dat").write_text("1 aggregate\n2 dish_washer\n3 dish_washer\n")
    found = IN.label_channels(IN.channel_files(spark, f"{tmp_path}/*/channel_*.dat"), IN.channel_labels(spark, f"{tmp_path}/*/labels.dat"))
    assert sorted((r["house"], r["appliance"], r["watts"]) for r in found.collect()) == [(1, "aggregate", 1.5), (1, "aggregate", 2.0), (1, "dishwasher", 3.0), (2, "aggregate", 4.0)]
    (tmp_path / "House_3.csv").write_text("Time,Unix,Aggregate,Appliance1,Issues\n2024-01-01 00:00:00,1,5,6,0\n")
    (tmp_path / "names").write_text("House_id,Time,Unix,Aggregate,Appliance1,Issues\n3,Time,Unix,Aggregate,Kettle,Issues\n")
    wide = IN.wide_house(spark, f"{tmp_path}/House_3.csv", r"House_(\d+)").join(IN.house_labels(spark, f"{tmp_path}/names"), ["house", "ordinal"])
    assert sorted((r["appliance"], r["watts"]) for r in wide.collect()) == [("Aggregate", 5.0), ("Kettle", 6.0)]


def test_summary_is_read_back(spark, tmp_path):
    steps = spark.createDataFrame([("train", 1, 1), ("train", 2, 0), ("test", 3, 0)], "split string, idx int, status int")
    made = OUT.read_summary(spark, str(tmp_path / "none"), steps)
    assert {r["split"]: r["n_on"] for r in made.collect()} == {"train": 1, "test": 0}
    made.write.option("header", True).csv(str(tmp_path / "s"))
    assert {r["split"]: r["n_on"] for r in OUT.read_summary(spark, str(tmp_path / "s"), steps).collect()} == {"train": 1, "test": 0}


def test_profiles_keep_the_overlap(spark):
    ts = datetime.datetime(2024, 1, 1)
    rows = [(1, a, ts + datetime.timedelta(seconds=10 * k), 100.0 if a == "aggregate" else 50.0) for a, n in (("aggregate", 12), ("kettle", 9)) for k in range(n)]
    df = spark.createDataFrame(rows, "house int, appliance string, ts timestamp_ntz, watts double")
    found = prepare(df, Profile("channels", {"kettle": Rules(40, 300, 2)}, factor=3)).orderBy("k").collect()
    assert [(r["x"], r["status"], r["total"]) for r in found] == [(50.0, 1, 100.0)] * 3


def test_grouped_fit(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + 1) for i in range(5)] + [("b", 1.0, 4.0)], "g string, x double, y double")
    found = {r["g"]: (r["slope"], r["intercept"]) for r in X.grouped_fit(df, ["g"], "x", "y").collect()}
    assert found == {"a": (2.0, 1.0), "b": (None, None)}


def test_streams(spark, tmp_path):
    from meterlake.streaming import live

    ts = datetime.datetime(2024, 1, 1)
    rows = [(1, ts + datetime.timedelta(seconds=s), w) for s, w in ((0, 50.0), (4, 70.0), (12, 60.0), (400, 50.0))]
    schema = "house long, ts timestamp, watts double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, made, mode in (("means", live.bucket_means(source, ["house"]), "complete"), ("on", live.on_sessions(source, ["house"], "20 seconds", 40, 300), "complete"), ("gaps", live.last_values(source, "house", 60), "append")):
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert {r["x"] for r in spark.table("means").collect()} == {60.0, 50.0}
    assert sorted(r["readings"] for r in spark.table("on").collect()) == [1, 3]
    assert [r["gap_s"] for r in spark.table("gaps").orderBy("ts").collect()] == [None, 4.0, 8.0, None]


def test_grids_in_blocks(spark):
    df = spark.createDataFrame([(1, -7, 1.0), (1, 12, 2.0), (2, 5, 3.0)], "house int, k long, x double")
    for block in (1, 4, 100):
        found = {(r["house"], r["k"]): r["x"] for r in R.dense(df, ["house"], block=block).collect()}
        assert set(found) == {(1, k) for k in range(-7, 13)} | {(2, 5)} and found[1, -7] == 1.0 and found[1, 0] is None


def test_running_sums_are_those_of_one_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), rng.randint(0, 9)) for _ in range(300)]
    df = spark.createDataFrame([(None if a is None else float(a), b, i) for i, (a, b) in enumerate(rows)], "s double, v long, i long").where("s is not null")
    for descending in (False, True):
        order = [F.desc("s") if descending else F.col("s"), F.col("i")]
        found = running_sums(value_ranges(df, "s", 7, 2, descending), F.col("value_range"), order, {"before": F.col("v")}).collect()
        kept = sorted((r for r in df.collect()), key=lambda r: (-r["s"] if descending else r["s"], r["i"]))
        at, expect = 0, {}
        for r in kept:
            expect[r["i"]] = at
            at += r["v"]
        assert {r["i"]: r["before"] for r in found} == expect and {r["before_total"] for r in found} == {at}


def test_ranked_metrics_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.1, 0.2, 0.25, 0.7, 0.9]) + rng.choice([0, rng.random()]), rng.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "score double, label int")
    on, off = ([s for s, y in rows if y == i] for i in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in on for b in off) / len(on) / len(off)
    assert abs(E.roc_auc(df).first()["roc_auc"] - auc) < 1e-12
    steps = sorted({s for s, _ in rows}, reverse=True)
    ap = sum(sum(y for s, y in rows if s == t) * sum(y for s, y in rows if s >= t) / sum(s >= t for s, _ in rows) for t in steps) / len(on)
    assert abs(E.average_precision(df).first()["ap"] - ap) < 1e-12
    assert E.roc_auc(df.limit(0)).first()["roc_auc"] is None


def test_shuffle_and_shares(spark):
    df = spark.range(5000)
    places = [r["place"] for r in L.shuffled(df, "id", 3).collect()]
    assert places == list(range(1, 5001))
    shares = {r["split"]: r["count"] / 5000 for r in L.split_by_share(df, "id", 0.2, 0.1, seed=3).groupBy("split").count().collect()}
    assert abs(shares["test"] - 0.2) < 0.03 and abs(shares["valid"] - 0.1) < 0.03


def test_preparation_in_chunks_is_that_of_the_whole(spark):
    rng = random.Random(4)
    ts = datetime.datetime(2024, 1, 1, 22)
    rows = [(1, a, ts + datetime.timedelta(seconds=10 * k), float(rng.choice([0, 0, 60, 60, 60, 400]))) for a in ("aggregate", "kettle", "fridge") for k in range(3000) if rng.random() < (0.95 if k % 300 < 200 else 0.05)]
    df = spark.createDataFrame(rows, "house int, appliance string, ts timestamp_ntz, watts double")
    rules = {"kettle": Rules(40, 300, 4, 6, 2), "fridge": Rules(40, 300, 1, 0, 0)}
    for kw in ({}, {"anchor": "day", "soft_label": True}, {"long_gap": None}):
        found = [sorted(map(str, prepare(df, Profile("channels", rules, chunk=chunk, **kw)).collect())) for chunk in (50, 1 << 20)]
        assert found[0] == found[1] and found[0]


def test_gap_filling_and_sliding_windows_against_plain_loops(spark):
    rng = random.Random(5)
    for _ in range(4):
        x = []
        while len(x) < 120:
            x += [float(rng.randint(1, 99)) for _ in range(rng.randint(1, 6))] + [None] * rng.choice([0, 1, 5, 6, 7, 12, 13, 20])
        at, expect = 0, list(x)
        while at < len(x):
            end = at
            while end < len(x) and x[end] is None:
                end += 1
            if end - at > 12:
                expect[at:end] = [0.0] * (end - at)
            elif end > at and at:
                expect[at : min(end, at + 6)] = [expect[at - 1]] * (min(end, at + 6) - at)
            at = max(end, at + 1)
        made = R.forward_fill(R.fill_long_gaps_zero(series(spark, x), ["house"], 12), ["house"], 6)
        assert values(made) == expect
        found = {(r["win"], r["step"]): r["k"] for r in W.cut(series(spark, x), ["house"], 24, 6).collect()}
        assert found == {(i, j): 6 * i + j for i in range((len(x) - 24) // 6 + 1) for j in range(24)}


def test_fitted_models_are_better_than_the_mean(spark):
    rng = random.Random(6)
    rows = []
    for k in range(600):
        on = (k // 7) % 3 == 0
        rows.append((1, k, 80.0 * on + rng.random(), 80.0 * on + 20 * rng.random(), int(on)))
    df = spark.createDataFrame(rows, "house int, k long, y double, agg double, s int")
    steps, names = X.step_features(df, ["house"])
    power = X.predict(X.fit_step_power(steps, names), steps, names).selectExpr("avg(abs(y - prediction)) e", "avg(abs(y - 26)) m").first()
    assert power["e"] < 0.3 * power["m"]
    assert X.predict(X.fit_step_state(steps, names), steps, names).selectExpr("avg(cast(s = prediction as int)) a").first()["a"] > 0.95
    wins = W.cut(df.withColumnRenamed("y", "x"), ["house"], 12)
    features = X.window_features(wins, ["house"]).join(W.energy(wins, ["house"]), ["house", "win"])
    columns = ["mean", "std", "high", "low", "first", "last"]
    energy = X.predict(X.fit_window_energy(features, columns), features, columns).selectExpr("max(abs(energy - prediction)) e", "max(energy) m").first()
    assert energy["e"] < 0.05 * energy["m"]


def test_known_values(spark):
    assert J.check_names(["kettle"], known.APPLIANCES["ukdale"]) == ["kettle"]
    with pytest.raises(ValueError, match="toaster"):
        J.check_names(["kettle", "toaster"], known.APPLIANCES["ukdale"])
    for dataset, names in known.APPLIANCES.items():
        for durations in (True, False):
            assert {r["appliance"] for r in known.rule_table(spark, dataset, durations).collect()} <= set(names)
    assert known.meter_table(spark).where("house = 1 and appliance = 'WashingMachine'").first()["meters"] == [10, 20]
    assert known.split_table(spark, "redd").where("appliance = 'Fridge' and split = 'test'").first()["house"] == 1
    assert known.houses_with(spark).where("appliance = 'Kettle'").count() == 12


def test_scale_of_the_train_split(spark):
    df = spark.createDataFrame([("a", "train", 2.0), ("a", "test", 8.0), ("b", "train", 4.0)], "appliance string, split string, x double")
    assert {r["appliance"]: r["s2"] for r in K.fit_on(df, K.Scaling.MAX, "x", ["appliance"]).collect()} == {"a": 2.0, "b": 4.0}


def test_cluster_without_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Fake)
