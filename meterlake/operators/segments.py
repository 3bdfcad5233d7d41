"""Runs, places and carried values over series of any length, by segments.

A series is cut into segments of `size` buckets. A task orders one segment; what a segment means for the
rest of its series is a summary of one row (first and last state, number of runs, number of rows, last
value), and summaries are merged in order by a running sum or a last value over them. So no task sees a
series, and no halo bounds how far a run or a carried value may reach: a run over a thousand segments
is a thousand pieces, put together again by their number.

Rows need a bucket number k; series may have holes and start anywhere. Rows that repeat a k stand side by
side, in no fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Buckets of a segment.
SIZE = 65_536


def segmented(df: DataFrame, size: int = SIZE, k: str = "k") -> DataFrame:
    return df.withColumn("__segment", F.floor(F.col(k) / size))


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("__segment")


def _numbered(df: DataFrame, keys: list[str], flag: Column, size: int, k: str) -> DataFrame:
    """Adds __segment, __flag and __own, the number of the run within the segment from 0; a null state is a run of its own."""
    w = Window.partitionBy(*keys, "__segment").orderBy(k)
    rows = segmented(df, size, k).withColumn("__flag", flag)
    change = F.coalesce((F.col("__flag") != F.lag("__flag").over(w)).cast("int"), F.lit(1))
    return rows.withColumn("__own", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def _bases(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, __segment, __base: the number of the segment's first run in its series, from 1.

    pieces: keys, __segment, __own, __flag, one row for each run of a segment.
    """
    ends = pieces.groupBy(*keys, "__segment").agg(F.min_by("__flag", "__own").alias("first"), F.max_by("__flag", "__own").alias("last"), F.max("__own").alias("more"))
    before = F.lag("last").over(_order(keys))
    # a run goes on where the state before the segment is the state it begins with
    steps = ends.withColumn("__opened", F.coalesce((F.col("first") != before).cast("int"), F.lit(1)))
    steps = steps.withColumn("__past", F.coalesce(F.lag("more").over(_order(keys)), F.lit(0)))
    base = F.sum(F.col("__opened") + F.col("__past")).over(_order(keys).rowsBetween(Window.unboundedPreceding, 0))
    return steps.select(*keys, "__segment", base.alias("__base"))


def run_ids(df: DataFrame, keys: list[str], flag: Column, name: str = "run", size: int = SIZE, k: str = "k") -> DataFrame:
    """Adds the number of the run of equal states that a row is in, from 1 in each series."""
    rows = _numbered(df, keys, flag, size, k)
    pieces = rows.groupBy(*keys, "__segment", "__own").agg(F.first("__flag").alias("__flag"))
    both = rows.join(_bases(pieces, keys), [*keys, "__segment"])
    return both.withColumn(name, (F.col("__base") + F.col("__own")).cast("long")).select(*df.columns, name)


def run_sizes(df: DataFrame, keys: list[str], flag: Column, name: str = "size", size: int = SIZE, k: str = "k") -> DataFrame:
    """Adds the number of rows of the run of equal states that a row is in."""
    rows = _numbered(df, keys, flag, size, k)
    pieces = rows.groupBy(*keys, "__segment", "__own").agg(F.first("__flag").alias("__flag"), F.count("*").alias("__n"))
    told = pieces.join(_bases(pieces, keys), [*keys, "__segment"]).withColumn("__run", F.col("__base") + F.col("__own"))
    # pieces of one run, of which a segment has one at most
    whole = told.withColumn(name, F.sum("__n").over(Window.partitionBy(*keys, "__run"))).select(*keys, "__segment", "__own", name)
    return rows.join(whole, [*keys, "__segment", "__own"]).select(*df.columns, name)


def runs(df: DataFrame, keys: list[str], flag: Column, sums: dict[str, Column] | None = None, size: int = SIZE, k: str = "k") -> DataFrame:
    """keys, start, end (exclusive), steps and sums of every run of rows whose state is 1."""
    sums = sums or {}
    rows = _numbered(df, keys, flag, size, k)
    pieces = rows.groupBy(*keys, "__segment", "__own").agg(
        F.first("__flag").alias("__flag"), F.min(k).alias("start"), (F.max(k) + 1).alias("end"), F.count("*").alias("steps"), *(F.sum(c).alias(n) for n, c in sums.items())
    )
    told = pieces.join(_bases(pieces, keys), [*keys, "__segment"]).where(F.col("__flag") == 1)
    whole = told.groupBy(*keys, (F.col("__base") + F.col("__own")).alias("__run"))
    return whole.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("steps").alias("steps"), *(F.sum(n).alias(n) for n in sums)).drop("__run")


def positions(df: DataFrame, keys: list[str], k: str = "k", size: int = SIZE) -> DataFrame:
    """Adds pos, the row's number in its series from 0. Series may have holes."""
    rows = segmented(df, size, k)
    counts = rows.groupBy(*keys, "__segment").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(_order(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "__segment", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys, "__segment").orderBy(k)) - 1
    return rows.withColumn("__own", own).join(starts, [*keys, "__segment"]).withColumn("pos", (F.col("__before") + F.col("__own")).cast("long")).select(*df.columns, "pos")


def ends(df: DataFrame, keys: list[str], k: str = "k") -> DataFrame:
    """keys, lo, hi: first and last bucket of each series."""
    return df.groupBy(*keys).agg(F.min(k).alias("lo"), F.max(k).alias("hi"))


def dense_positions(df: DataFrame, keys: list[str], k: str = "k") -> DataFrame:
    """Adds pos on a grid without holes, where it is k - first k, and __len, the series' length; nothing is ordered."""
    both = df.join(ends(df, keys, k).select(*keys, F.col("lo").alias("__lo"), (F.col("hi") - F.col("lo") + 1).alias("__len")), keys)
    return both.withColumn("pos", (F.col(k) - F.col("__lo")).cast("long")).drop("__lo")


def carry_last(df: DataFrame, keys: list[str], columns: dict[str, Column | str], size: int = SIZE, k: str = "k", order: list[Column | str] = ()) -> DataFrame:
    """Adds, per name in columns, the last value that is not null at or before the row in its series, however far back.

    order: what orders rows of one k, where that matters.
    """
    rows = segmented(df, size, k).select("*", *((F.col(c) if isinstance(c, str) else c).alias(f"__v_{n}") for n, c in columns.items()))
    by = [k, *order]
    last = rows.groupBy(*keys, "__segment").agg(*(F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.struct(*by))).alias(f"__l_{n}") for n in columns))
    past = _order(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "__segment", *(F.last(f"__l_{n}", ignorenulls=True).over(past).alias(f"__c_{n}") for n in columns))
    inside = Window.partitionBy(*keys, "__segment").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.last(f"__v_{n}", ignorenulls=True).over(inside).alias(f"__i_{n}") for n in columns))
    both = rows.join(carried, [*keys, "__segment"])
    return both.select(*df.columns, *(F.coalesce(f"__i_{n}", f"__c_{n}").alias(n) for n in columns))
