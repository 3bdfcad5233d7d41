"""Writers and readers of windows, splits, predictions and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlake.operators import windows as win


def long_windows(packed: DataFrame) -> DataFrame:
    """window_idx, timestep, house_id, start_date, agg_power, agg_state, app_power, app_state from packed windows with those arrays."""
    rows = win.unpack(packed, ["house"], ["agg_power", "agg_state", "app_power", "app_state"])
    return rows.select(F.col("win").alias("window_idx"), F.col("step").alias("timestep"), F.col("house").alias("house_id"), F.col("start_k").alias("start_date"), "agg_power", "agg_state", "app_power", "app_state")


def write_by_split(df: DataFrame, path: str, mode: str = "errorifexists", kind: str = "parquet") -> None:
    df.write.mode(mode).partitionBy("split").format(kind).save(path)


def split_export(windows: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """Per split the first n windows (0: all)."""
    from meterlake.operators.splits import cap_samples

    return cap_samples(windows, ["split"], order, n)


def on_index(windows: DataFrame) -> DataFrame:
    """split, idx of windows with an ON step; a split without one has no row."""
    return windows.where(F.exists("state", lambda s: s == 1)).select("split", "idx")


def split_summary(windows: DataFrame, written: DataFrame, splits: list[str]) -> DataFrame:
    """One row per appliance: n, written, on and pct_on of each split. windows: appliance, split, idx, on."""
    both = windows.join(written.select("appliance", "split", "idx").withColumn("w", F.lit(1)), ["appliance", "split", "idx"], "left")
    return both.groupBy("appliance").pivot("split", splits).agg(F.count(F.lit(1)).alias("n"), F.count("w").alias("written"), F.count_if(F.col("on") == 1).alias("on"), (F.count_if(F.col("on") == 1) * 100 / F.count(F.lit(1))).alias("pct_on"))


def read_summary(spark: SparkSession, path: str, windows: DataFrame) -> DataFrame:
    """split, n, n_on, pct_on: the written summary where there is one, else the same counts from the windows (split, status)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.option("header", True).schema("split string, n long, n_on long, pct_on double").csv(path)
    one = windows.groupBy("split", "idx").agg(F.max((F.col("status") == 1).cast("int")).alias("on"))
    return one.groupBy("split").agg(F.count("*").alias("n"), F.sum("on").alias("n_on"), (F.sum("on") * 100 / F.count("*")).alias("pct_on"))


def eval_samples(real: DataFrame, synthetic: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Test windows with the real and, where there is one, the synthetic aggregate side by side."""
    other = synthetic.select(*keys, *(F.col(c).alias(f"synth_{c}") for c in columns))
    return real.join(other, keys, "left")


def prediction_windows(pred: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Flat predictions by position, as windows: keys, window_idx, timestep, prediction."""
    return pred.select(*keys, F.floor(F.col("pos") / size).alias("window_idx"), (F.col("pos") % size).alias("timestep"), "prediction")


def scan_runs(spark: SparkSession, path: str, metrics: list[str], kind: str = "json") -> DataFrame:
    """Run logs below path with their file and one column per metric, NULL where a log has none."""
    schema = "model string, dataset string, appliance string, rate string, window int, seed int, metrics map<string,double>, loss_train array<double>, loss_valid array<double>, training_time double"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).format(kind).load(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), *(F.element_at("metrics", m).alias(m) for m in metrics))


def append_timing(spark: SparkSession, path: str, name: str, train_s: float, eval_s: float) -> None:
    append_timings(spark.createDataFrame([(name, float(train_s), float(eval_s))], "experiment string, train_time double, eval_time double"), path)


def append_timings(rows: DataFrame, path: str) -> None:
    """Adds rows of experiment, train_time, eval_time to the table at path."""
    rows.select("experiment", F.col("train_time").cast("double"), F.col("eval_time").cast("double")).write.mode("append").option("header", True).csv(path)


def write_metrics_table(df: DataFrame, path: str, keys: list[str]) -> None:
    df.orderBy(*keys).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
