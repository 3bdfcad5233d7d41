"""Running sums and places over a whole table in one order, without one task that sees all rows.

Rows are dealt into ranges of the order. A first, small aggregation gives what stands before each
range; within a range a window does the rest. The result is that of one window over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sums(df: DataFrame, ranges: Column, order: list[Column | str], columns: dict[str, Column]) -> DataFrame:
    """df with, per name in columns, the sum of its column over all rows before this one, and `<name>_total` over all.

    ranges: a whole number per row that never falls along the order; one row for each is held by one task.
    """
    df = df.withColumn("__range", ranges)
    sums = df.groupBy("__range").agg(*(F.sum(c).alias(n) for n, c in columns.items()))
    # one row per range: few, whatever the table's size
    w = Window.orderBy("__range")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__range", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in columns), *(F.sum(n).over(Window.partitionBy()).alias(f"{n}_total") for n in columns))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = df.join(F.broadcast(starts), "__range")
    made = both.select("*", *((F.col(f"__{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in columns.items()))
    return made.drop("__range", *(f"__{n}" for n in columns))


def value_ranges(df: DataFrame, value: str, n: int = 4096, refine: int = 64, descending: bool = False, name: str = "value_range") -> DataFrame:
    """df with a whole number that never falls along the value's order, for running_sums; nothing runs until the result is used.

    Values go into n equal bins between the smallest and the largest. A bin with more than 1 / refine
    of the rows is cut into n of its own between its smallest and largest value, so that crowded values
    are no single range. NaN and infinite values have the ranges at the ends.
    """
    x = F.col(value).cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    def place(low: str, high: str) -> Column:
        # halves, so that no difference of finite values is infinite
        share = F.try_divide(x / 2 - F.col(low) / 2, F.col(high) / 2 - F.col(low) / 2)
        inside = F.coalesce(F.least(F.floor(share * n), F.lit(n - 1)), F.lit(0))
        return F.when(finite.isNotNull(), inside).when(x == float("-inf"), 0).when(x.isNull(), 0).otherwise(n - 1)

    ends = df.agg(F.min(finite).alias("__low"), F.max(finite).alias("__high"))
    rows = df.crossJoin(F.broadcast(ends)).withColumn("__bin", place("__low", "__high")).drop("__low", "__high")
    # n rows at most, so one task may see them
    bins = rows.groupBy("__bin").agg(F.count("*").alias("__n"), F.min(finite).alias("__low"), F.max(finite).alias("__high"))
    bins = bins.select("__bin", "__low", "__high", (F.col("__n") * refine > F.sum("__n").over(Window.partitionBy())).alias("__crowded"))
    rows = rows.join(F.broadcast(bins), "__bin")
    ranged = F.col("__bin") * n + F.when(F.col("__crowded"), place("__low", "__high")).otherwise(0)
    return rows.withColumn(name, -ranged if descending else ranged).drop("__bin", "__low", "__high", "__crowded")
