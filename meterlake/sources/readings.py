"""Scans of meter readings in three layouts, all to one long table (house, appliance or channel, ts, watts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

CHANNEL_SCHEMA = "epoch_s long, watts double"
LABEL_SCHEMA = "channel int, appliance_name string"
#: Names that stand for others in channel dictionaries.
RENAMED = {"dish_washer": "dishwasher"}


def path_part(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def channel_files(spark: SparkSession, path: str, house: str = r"house_(\d+)", channel: str = r"channel_(\d+)\.") -> DataFrame:
    """Headerless `epoch watts` files, one per channel: house, channel, ts, watts."""
    rows = spark.read.schema(CHANNEL_SCHEMA).option("sep", " ").csv(path)
    return rows.select(path_part(house).cast("int").alias("house"), path_part(channel).cast("int").alias("channel"), F.timestamp_seconds("epoch_s").alias("ts"), "watts")


def channel_labels(spark: SparkSession, path: str, house: str = r"house_(\d+)", renamed: dict[str, str] = RENAMED) -> DataFrame:
    """house, channel, appliance; of several channels with one name the first counts."""
    rows = spark.read.schema(LABEL_SCHEMA).option("sep", " ").csv(path)
    names = F.create_map(*(F.lit(x) for kv in renamed.items() for x in kv))
    named = rows.select(path_part(house).cast("int").alias("house"), "channel", F.coalesce(F.element_at(names, F.trim("appliance_name")), F.trim("appliance_name")).alias("appliance"))
    return first_of(named, ["house", "appliance"], "channel")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__rn = 1").drop("__rn")


def label_channels(readings: DataFrame, labels: DataFrame) -> DataFrame:
    """Readings of labelled channels, by appliance."""
    return readings.join(labels, ["house", "channel"]).select("house", "appliance", "ts", "watts")


def wide_house(spark: SparkSession, path: str, house: str = r"house_?(\d+)", issues: str = "Issues") -> DataFrame:
    """Wide files with a header, long by ordinal: house, ordinal, ts, issue, watts. Names repeat within a house, the ordinal does not."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    fixed = {"Time", "Unix", issues}
    values = [c for c in rows.columns if c not in fixed]
    long = rows.select(path_part(house).cast("int").alias("house"), F.to_timestamp("Time").alias("ts"), F.col(issues).cast("int").alias("issue"), *(F.col(c).cast("double").alias(str(i)) for i, c in enumerate(values)))
    return long.unpivot(["house", "ts", "issue"], [str(i) for i in range(len(values))], "ordinal", "watts").withColumn("ordinal", F.col("ordinal").cast("int"))


def house_labels(spark: SparkSession, path: str) -> DataFrame:
    """house, ordinal, appliance from the positional name table (the columns after House_id, Time, Unix and before Issues)."""
    rows = spark.read.option("header", True).csv(path)
    values = [c for c in rows.columns if c not in ("House_id", "Time", "Unix", "Issues")]
    wide = rows.select(F.col("House_id").cast("int").alias("house"), *(F.trim(F.col(c)).alias(str(i)) for i, c in enumerate(values)))
    return wide.unpivot("house", [str(i) for i in range(len(values))], "ordinal", "appliance").withColumn("ordinal", F.col("ordinal").cast("int"))


def meter_tables(spark: SparkSession, path: str, zone: str = "US/Eastern") -> DataFrame:
    """Landed Parquet of (house, meter, index_ns, power): house, meter, ts (UTC), local_ts, watts."""
    rows = spark.read.parquet(path)
    ts = F.timestamp_micros(F.expr("index_ns div 1000"))
    return rows.select("house", "meter", ts.alias("ts"), F.from_utc_timestamp(ts, zone).alias("local_ts"), F.col("power").cast("double").alias("watts"))


def meter_map(houses: DataFrame, meters: DataFrame) -> DataFrame:
    """house, appliance, meter for every house; meter NULL where the appliance is not present. meters: house, appliance, meters array."""
    names = meters.select("appliance").distinct()
    grid = houses.select("house").distinct().crossJoin(F.broadcast(names))
    return grid.join(meters, ["house", "appliance"], "left").select("house", "appliance", F.explode_outer("meters").alias("meter"))


def house(df: DataFrame, which: int) -> DataFrame:
    """One house; prunes partitions where the table is written by house."""
    return df.where(F.col("house") == which)
