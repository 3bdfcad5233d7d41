"""Small helpers for jobs over texts: Arrow batches, cut lineage, joins on hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from meterlake.sources.folders import shared_folder


#: Bytes of an Arrow batch, of which a task holds several: Spark's own buffer, the worker's, and what is made of it.
BATCH_BYTES = "8m"


def in_small_batches(df: DataFrame) -> DataFrame:
    """df; where its session sets no bound on the bytes of Arrow batches itself, they are bounded by BATCH_BYTES."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, BATCH_BYTES)
    return df


def parts(batches, rows: int = 500):
    """The batches in slices of few rows, so that a worker holds the texts of one slice as Python objects only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    # workers live on: what a task's batches took goes back
    pa.default_memory_pool().release_unused()


def parts_of_size(batch, column: str, size: int):
    """The batch in slices with at most `size` bytes in the column, but for a single longer value."""
    sizes = np.nan_to_num(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False).astype(float))
    total, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + size, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_texts(docs: DataFrame, id_col: str, text_col: str, search: Callable[[list], dict], types: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """The id column as it is, and the columns that search makes of each batch's texts.

    types: per column its Spark type and Arrow type.
    """

    def run(batches):
        for batch in parts(batches):
            made = search(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(made[c], t) for c, (_, t) in types.items())], names=[id_col, *types])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{c} {s}" for c, (s, _) in types.items())]))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def cut(df: DataFrame) -> DataFrame:
    """df, written once as a table `cut-...` to the shared folder and read again.

    Later stages then depend on these files alone, not on executors. The tables stay until the
    folder's owner clears it.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, size: Column | None = None, most: int = 1_000_000) -> DataFrame:
    """df, cut; marked for broadcast if its rows, or the sum of size over them, are counted to be at most `most`."""
    df = cut(df)
    n = df.agg(F.count("*") if size is None else F.sum(size)).first()[0] or 0
    return F.broadcast(df) if n <= most else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that adaptive execution can split at hot keys.

    A side that was just aggregated by the keys would keep its partitioning, and a hot key of the
    other side could not be split then. A further key made of the others has both sides dealt anew.
    """
    key = F.xxhash64(*on)
    return left.withColumn("__spread", key).join(right.withColumn("__spread", key), ["__spread", *on], how).drop("__spread")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def filter_texts(docs: DataFrame, text_col: str, keep: Callable[[list], list]) -> DataFrame:
    """The rows, with all columns, whose text keep marks true; keep gets each batch's texts."""
    # by place, as names may hold anything
    rows = in_small_batches(docs).toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index(text_col)}"

    def run(batches):
        for batch in parts(batches):
            yield batch.filter(pa.array(keep(batch[text].to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
