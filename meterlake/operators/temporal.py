"""Joins in time: the last row at or before, and overlapping intervals, without comparing all pairs of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterlake.operators import segments


def as_of(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", tolerance_s: int | None = None, slice_s: int = 86_400, prefix: str = "last_") -> DataFrame:
    """left, and per row the ts and columns of right's last row at or before it with the same keys, under prefixed names.

    Both sides go into one order of time, cut into slices of slice_s seconds; what a slice needs from
    before is one row, carried over slices however many lie between. A hot key is as many groups as it has
    slices. At one ts right comes first, and of several rows of right there the largest by their columns
    counts. Rows of right further back than tolerance_s give nulls, as no row does; null keys or times match nothing.
    """
    micros = lambda df: F.unix_micros(df[ts].cast("timestamp"))
    told = F.struct(F.col(ts), *columns)
    whole = F.col(ts).isNotNull()
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    rows = left.select(*keys, F.struct(*left.columns).alias("__row"), micros(left).alias("k"), F.lit(1).alias("__side"), whole.alias("__whole"))
    known = right.where(whole).select(*keys, micros(right).alias("k"), F.lit(0).alias("__side"), told.alias("__told"))
    carried = segments.carry_last(rows.where("__whole").drop("__whole").unionByName(known, allowMissingColumns=True), keys, {"__found": "__told"}, size=slice_s * 1_000_000, order=["__side", "__told"])
    found = F.col("__found")
    if tolerance_s is not None:
        near = F.col("k") - F.unix_micros(found[ts].cast("timestamp")) <= tolerance_s * 1_000_000
        found = F.when(near, found)
    made = carried.where("__side = 1").select("__row", found.alias("__found"))
    made = made.unionByName(rows.where("not __whole").select("__row"), allowMissingColumns=True)
    return made.select("__row.*", *(F.col(f"__found.{c}").alias(f"{prefix}{c}") for c in [ts, *columns]))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", bucket: int = 64, fan: int = 16, prefix: str = "r_") -> DataFrame:
    """Every pair of intervals [start, end) of one key that overlap: left's columns, right's under prefixed names, and overlap, the steps they share.

    Starts and ends are whole numbers. Intervals are dealt to buckets of a width that suits their length: `bucket`,
    or that times a power of fan, so that each stands in fan + 1 buckets at most however long it is. The two sides meet
    once per pair of widths, in buckets of the wider one; a pair counts in the bucket of the later start alone.
    Empty intervals, and those with a null key, start or end, overlap nothing.
    """
    level = F.greatest(F.ceil(F.log(float(fan), (F.col(end) - F.col(start)) / F.lit(float(bucket * fan)))), F.lit(0)).cast("int")
    sized = lambda df: df.where(F.col(start) < F.col(end)).withColumn("__level", level)
    one = sized(left).withColumnsRenamed({start: "__s", end: "__e"})
    two = sized(right).select(*keys, F.col("__level").alias("__rlevel"), F.col(start).alias("__rs"), F.col(end).alias("__re"), *(F.col(c).alias(f"{prefix}{c}") for c in right.columns if c not in keys))
    # the levels that the other side has: few, as they grow with the logarithm of a length
    wide_two, wide_one = (F.broadcast(df.agg(F.collect_set(c).alias("__levels"))) for df, c in ((two.select("__rlevel"), "__rlevel"), (one.select("__level"), "__level")))
    width = F.lit(bucket) * F.pow(F.lit(fan), F.col("__top"))

    def dealt(df: DataFrame, own: str, others: DataFrame, first: str, last: str) -> DataFrame:
        tops = F.array_distinct(F.transform("__levels", lambda x: F.greatest(x, F.col(own))))
        rows = df.crossJoin(others).withColumn("__top", F.explode(tops)).drop("__levels")
        low, high = F.floor(F.col(first) / width), F.floor((F.col(last) - 1) / width)
        return rows.withColumn("__bucket", F.explode(F.sequence(low, high)))

    a, b = dealt(one, "__level", wide_two, "__s", "__e"), dealt(two, "__rlevel", wide_one, "__rs", "__re")
    # one side of a pair has the width of the bucket: narrow intervals of both sides don't meet in a wide one
    on = [*keys, "__top", "__bucket"]
    both = a.where("__level = __top").join(b, on).unionByName(a.where("__level < __top").join(b.where("__rlevel = __top"), on))
    later = F.greatest("__s", "__rs")
    pairs = both.where((F.col("__s") < F.col("__re")) & (F.col("__rs") < F.col("__e")) & (F.floor(later / width) == F.col("__bucket")))
    names = [F.col("__s").alias(start) if c == start else F.col("__e").alias(end) if c == end else F.col(c) for c in left.columns]
    return pairs.select(*names, *(c for c in two.columns if c.startswith(prefix)), (F.least("__e", "__re") - later).alias("overlap"))
