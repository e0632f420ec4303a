"""Ranks and running sums over groups of any size.

A plain window puts a whole group into one task. Here each group is cut into ordered
buckets: per-bucket totals (partially aggregated, a few rows a group) give each bucket's
offset, and a window inside (group, bucket) does the rest. The bucket must be monotone in
the order, so a group holding a third of all rows spreads over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import cut


#: Rows a bucket holds on average.
ROWS_A_BUCKET = 20_000


def buckets_for(rows: int) -> int:
    """Number of buckets for so many rows: a power of two, at least 256."""
    return max(256, 1 << (rows // ROWS_A_BUCKET).bit_length())


def hash_bucket(h: Column, buckets: int) -> Column:
    """Bucket of a 64-bit hash, monotone in the hash as a signed number."""
    return F.shiftright(h, 64 - (buckets - 1).bit_length()).cast("int")


def running_sum(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str, before: bool = False) -> DataFrame:
    """``out``: sum of ``value`` over the group's rows up to this one in (bucket, order); without this one if ``before``.

    ``order`` must be unique inside a bucket. Group columns must not be null.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__t"))
    prior = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__offset", F.coalesce(F.sum("__t").over(prior), F.lit(0))).drop("__t")
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.sum(value).over(inside) - (F.col(value) if before else F.lit(0))
    return df.withColumn(out, own).join(totals, keys).withColumn(out, F.col(out) + F.col("__offset")).drop("__offset")


def sorted_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """``out``: position from 1 in the group after a sort by ``order`` (which must be unique in the group; groups must not be null).

    Rows are range-partitioned by group and order and written once, so that the partition
    number is a bucket in that order: a group with a third of all rows spreads over partitions.
    """
    keys = [F.col(g) for g in group]
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy(*group, "__part").agg(F.count("*").alias("__t"))
    prior = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__offset", F.coalesce(F.sum("__t").over(prior), F.lit(0))).drop("__t")
    inside = W.partitionBy(*group, "__part").orderBy(*order)
    return placed.withColumn(out, F.row_number().over(inside)).join(totals, [*group, "__part"]).withColumn(out, (F.col(out) + F.col("__offset")).cast("int")).drop("__offset", "__part")
