"""Train, valid and test splits in hash order: exact counts, disjoint ids, the same for the same seed.

The order is that of md5(id:seed), so any SQL engine can repeat a split. Exact counts need a place for
each id, which is counted by ranges of the hash and then within a range, so no task sees all ids. For
splits by share without a sort use split_by_share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.operators.ordered import running_sums


def hash_order(id_col: Column | str, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def ranked(ids: DataFrame, id_col: str, seed: int) -> DataFrame:
    """ids with place (from 0 in hash order) and total."""
    order = hash_order(id_col, seed)
    ranges = F.conv(F.substring(order, 1, 4), 16, 10).cast("int")
    placed = running_sums(ids.select(id_col), ranges, [order, id_col], {"place": F.lit(1)})
    return placed.select(id_col, "place", F.col("place_total").alias("total"))


def split_counts(df: DataFrame, id_col: str, n_test: Column | int, n_valid: Column | int, seed: int = 0) -> DataFrame:
    """df with split: the first n_test ids in hash order are test, the next n_valid valid, the rest train."""
    ids = ranked(df.select(id_col).distinct(), id_col, seed)
    test, valid = (n if isinstance(n, Column) else F.lit(n) for n in (n_test, n_valid))
    split = F.when(F.col("place") < test, "test").when(F.col("place") < test + valid, "valid").otherwise("train")
    return df.join(ids.select(id_col, split.alias("split")), id_col)


def split_houses(df: DataFrame, seed: int = 0, n_test: int | None = None, share_test: float = 0.2, n_valid: int | None = None, share_valid: float = 0.2, id_col: str = "house") -> DataFrame:
    """By count, or max(1, int(n * share)) of the houses; fails where no house would be left to train on."""
    total = F.col("total")
    of = lambda n, share: F.lit(n) if n is not None else F.greatest(F.lit(1), F.floor(total * share).cast("int"))
    ids = ranked(df.select(id_col).distinct(), id_col, seed)
    test, valid = of(n_test, share_test), of(n_valid, share_valid)
    enough = F.when(test + valid < total, test).otherwise(F.raise_error(F.lit("no house left to train on")).cast("int"))
    split = F.when(F.col("place") < enough, "test").when(F.col("place") < test + valid, "valid").otherwise("train")
    return df.join(ids.select(id_col, split.alias("split")), id_col)


def split_entities(df: DataFrame, id_col: str, test: float = 0.2, valid: float = 0.0, seed: int = 0) -> DataFrame:
    """The first int(n * (1 - test)) ids are train and valid, the last of these int(their number * valid) valid; the rest is test."""
    ids = ranked(df.select(id_col).distinct(), id_col, seed)
    kept = F.floor(F.col("total") * (1 - test))
    train = kept - F.floor(kept * valid)
    split = F.when(F.col("place") < train, "train").when(F.col("place") < kept, "valid").otherwise("test")
    return df.join(ids.select(id_col, split.alias("split")), id_col)


def split_rows(df: DataFrame, id_col: str, test: float = 0.2, valid: float = 0.0, seed: int = 0) -> DataFrame:
    """Rows as entities: ceil(n * test) rows are test, then of the rest ceil(rest * valid) valid."""
    ids = ranked(df.select(id_col), id_col, seed)
    n_test = F.ceil(F.col("total") * test)
    n_valid = F.ceil((F.col("total") - n_test) * valid)
    split = F.when(F.col("place") < n_test, "test").when(F.col("place") < n_test + n_valid, "valid").otherwise("train")
    return df.join(ids.select(id_col, split.alias("split")), id_col)


def split_windows(df: DataFrame, id_col: str, test: float = 0.2, seed: int = 0) -> DataFrame:
    """Windows cut at int(n * (1 - test)) in hash order."""
    ids = ranked(df.select(id_col).distinct(), id_col, seed)
    split = F.when(F.col("place") < F.floor(F.col("total") * (1 - test)), "train").otherwise("test")
    return df.join(ids.select(id_col, split.alias("split")), id_col)


def split_by_share(df: DataFrame, id_col: str, test: float = 0.2, valid: float = 0.0, seed: int = 0) -> DataFrame:
    """No sort and no shuffle: each id's hash decides, so the counts hold on average only."""
    u = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + valid, "valid").otherwise("train"))


def split_fixed(df: DataFrame, lists: DataFrame) -> DataFrame:
    """By configured lists (appliance, house, split)."""
    return df.join(lists, ["appliance", "house"])


def shuffled(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """All rows in hash order, with their place from 1 in it."""
    order = hash_order(id_col, seed)
    ranges = F.conv(F.substring(order, 1, 4), 16, 10).cast("int")
    placed = running_sums(df, ranges, [order, id_col], {"place": F.lit(1)}).drop("place_total")
    return placed.withColumn("place", (F.col("place") + 1).cast("long")).orderBy("place")


def cap_samples(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first n rows per key; 0 takes all."""
    if not n:
        return df
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__rn") <= n).drop("__rn")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mask_steps(df: DataFrame, keys: list[str], x: str, seed: int = 0, share: float = 0.2) -> DataFrame:
    """For masked pre-training: masked (input), target and choice per step.

    Of the chosen share of the steps 80% become -1, 10% noise from N(0, 1), 10% stay; the target is -1
    at all other steps.
    """
    u, v = uniform(*keys, F.lit(f"a{seed}")), uniform(*keys, F.lit(f"b{seed}"))
    choice = F.when(u >= share, "none").when(v < 0.8, "mask").when(v < 0.9, "noise").otherwise("keep")
    df = df.withColumn("choice", choice)
    made = F.when(F.col("choice") == "mask", -1.0).when(F.col("choice") == "noise", F.randn(seed)).otherwise(F.col(x))
    return df.withColumn("masked", made).withColumn("target", F.when(F.col("choice") == "none", -1.0).otherwise(F.col(x)))
