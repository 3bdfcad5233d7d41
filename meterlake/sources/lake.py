"""Prepared readings that grow by appends: each append prepares the days it touches, not the whole history.

A lake is a folder of three tables: `readings` (a folder for each batch, then by house and day), `ledger`
(house, appliance, day, readings of each batch) and `prepared` (by house and day). An append writes its
readings, works out from the ledger which days of which houses its rows can change, prepares these from
their own days and those beside them, and overwrites their partitions; its ledger rows come last. Every step
overwrites what an earlier attempt left, and a batch that is in the ledger is not made again, so an
append that was broken off is simply made once more. Appends to one lake run one at a time.

A day that has readings of a series changes it from the series' last day with readings before to its next
one after: grids, long gaps and fills reach that far and no farther. What the rules over time see beyond
is a halo of `halo_days`, which must be as long as they reach.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meterlake.functions.numeric import seconds
from meterlake.plans.profiles import CHANNEL, Profile, prepare

DAY = 86_400


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of the lake, or None before the first append."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def halo_days(profile: Profile) -> int:
    """Days that the rules over time may look beyond a changed one."""
    rules = max((r.min_off + max(r.min_on, r.min_activation) for r in profile.rules.values()), default=0)
    steps = profile.fill + (profile.long_gap or 0) + rules + 2 + profile.factor
    return max(1, math.ceil(steps * profile.every / DAY))


def affected_days(present: DataFrame, touched: DataFrame) -> DataFrame:
    """house, day: what new readings of (house, appliance, day) in touched can change. present: all days with readings, old and new."""
    w = Window.partitionBy(*CHANNEL).orderBy("day")
    beside = present.select(*CHANNEL, "day", F.coalesce(F.lag("day").over(w), "day").alias("first"), F.coalesce(F.lead("day").over(w), "day").alias("last"))
    own = beside.join(touched, [*CHANNEL, "day"], "left_semi")
    return own.select("house", F.explode(F.sequence("first", "last")).alias("day")).distinct()


def needed_days(present: DataFrame, affected: DataFrame, halo: int) -> DataFrame:
    """house, appliance, day: the days with readings from which the affected ones can be made."""
    w = Window.partitionBy(*CHANNEL).orderBy("day")
    # a series' day matters to all days up to its neighbours
    first = F.least(F.col("day") - halo, F.coalesce(F.lag("day").over(w) + 1, F.col("day")))
    last = F.greatest(F.col("day") + halo, F.coalesce(F.lead("day").over(w) - 1, F.col("day")))
    reach = present.select(*CHANNEL, "day", first.alias("first"), last.alias("last")).alias("p")
    blocks = affected.groupBy("house").agg(F.sort_array(F.collect_set("day")).alias("days")).alias("a")
    return reach.join(blocks, "house").where(F.exists("days", lambda d: d.between(F.col("first"), F.col("last")))).select(*CHANNEL, "day")


def append(spark: SparkSession, lake: str, batch: str, readings: DataFrame, profile: Profile, mains: str = "aggregate", halo: int | None = None) -> int:
    """Adds readings (what prepare takes) as a batch; gives the number of (house, day) partitions that were prepared, 0 if the batch is there already.

    A profile with an anchor depends on the whole history and is refused, as is one whose grid does not divide a day.
    Rows with a null house, appliance or time are left out.
    """
    if profile.anchor:
        raise ValueError("an anchored preparation depends on the first readings of all")
    if DAY % (profile.every * profile.factor):
        raise ValueError("steps of the coarse grid must divide a day")
    ledger = _read(spark, f"{lake}/ledger")
    if ledger is not None and ledger.where(F.col("batch") == batch).limit(1).count():
        return 0
    halo = halo_days(profile) if halo is None else halo
    day = lambda df: F.floor(seconds("ts", df.schema["ts"].dataType.simpleString()) / DAY).cast("int")
    fresh = readings.where("house is not null and appliance is not null and ts is not null").withColumn("day", day(readings))
    # a folder a batch: a second attempt replaces what a first one left
    fresh.repartition("house", "day").write.mode("overwrite").partitionBy("house", "day").parquet(f"{lake}/readings/batch={batch}")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields)
    every = spark.read.schema(f"{kinds}, batch string").parquet(f"{lake}/readings")
    touched = every.where(F.col("batch") == batch).groupBy(*CHANNEL, "day").agg(F.count("*").alias("readings"))
    touched.write.mode("overwrite").parquet(f"{lake}/touched")
    touched = spark.read.parquet(f"{lake}/touched")
    present = touched.select(*CHANNEL, "day")
    if ledger is not None:
        present = present.unionByName(ledger.select(*CHANNEL, "day")).distinct()
    affected = affected_days(present, touched)
    affected.write.mode("overwrite").parquet(f"{lake}/affected")
    affected = spark.read.parquet(f"{lake}/affected")
    known = [batch] if ledger is None else [batch, *(r["batch"] for r in ledger.select("batch").distinct().collect())]
    # batches that were broken off have no ledger rows, and take no part
    inputs = every.where(F.col("batch").isin(known)).join(needed_days(present, affected, halo), [*CHANNEL, "day"], "left_semi").drop("day", "batch")
    made = prepare(inputs, profile, mains)
    made = made.withColumn("day", F.floor(F.col("k") * profile.every * profile.factor / DAY).cast("int"))
    changed = made.join(affected, ["house", "day"], "left_semi").repartition("house", "day")
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("house", "day").parquet(f"{lake}/prepared")
    n = affected.count()
    touched.write.mode("overwrite").parquet(f"{lake}/ledger/batch={batch}")
    return n


def prepared(spark: SparkSession, lake: str) -> DataFrame:
    """house, appliance, k, x, status, total of all appends; filters on house and day read their partitions only."""
    found = _read(spark, f"{lake}/prepared")
    if found is None:
        raise ValueError(f"nothing was appended to {lake}")
    return found
