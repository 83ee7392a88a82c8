"""Helpers that several operators of this package share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(batch, name: str) -> list[str]:
    """A text column of an Arrow batch, null as empty."""
    return ["" if s is None else s for s in batch.column(name).to_pylist()]


def slices(batches, rows: int):
    """Arrow batches of at most so many rows, so that a worker holds the Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_slices(batches, name: str, most: int):
    """Arrow batches cut where the texts of a column pass so many bytes; a row is never split."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def hash_bucket(key: Column, buckets: int) -> Column:
    """Order-preserving bucket of a uniform 64-bit key: equal shares, ascending with the key. ``buckets`` is a power of two."""
    bits = buckets.bit_length() - 1
    return (F.shiftright(key, 64 - bits) + F.lit(buckets // 2)).cast("int") if bits else F.lit(0)


def power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def running_total(df: DataFrame, group: str, key: str, tie: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group before this one, in the order (key, tie).

    ``key`` is a uniform hash. A group is cut into ``buckets`` ranges of it, so a
    group that holds a third of all rows is summed by many tasks; only the totals
    of (group, range) are summed in one place. ``df`` is read twice.
    """
    cut = df.withColumn("_cut", hash_bucket(F.col(key), buckets))
    totals = cut.groupBy(group, "_cut").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col(group).alias("_group"), F.col("_cut").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_cut").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(bases, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_cut") == F.col("_at")))
    return joined.withColumn(out, F.col("_base") + F.col("_local")).drop("_cut", "_group", "_at", "_base", "_local")
