"""Consecutive row numbers in a total order, without a single-partition window.

``row_number() over (order by k)`` moves every row into one task.  Instead the
rows are range-partitioned on the order key, sorted inside each partition, and
numbered as  offset(partition) + position in partition + 1.  The offsets come
from a per-partition count (one row per partition, bounded by the partition
count) and a running sum over that tiny table.

Both the counting and the numbering pass must see the very same partitions.
A range exchange samples its bounds with a seed taken from its RDD id, so two
plans over the same data can cut differently; the sorted rows are therefore
written once (as Parquet in the shared folder) and both passes read them.  This is the DataFrame form of RDD ``zipWithIndex``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

_LOW_BITS = (1 << 33) - 1   # monotonically_increasing_id: record number in the low 33 bits


def offsets_by_group(sizes: DataFrame, keys: list[str], size: str = "_size") -> DataFrame:
    """Running sum of ``size`` over ``keys`` (exclusive): one row per group in, one out."""
    running = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_offset", F.coalesce(F.sum(size).over(running), F.lit(0)))


def number_rows(df: DataFrame, order: list[str | Column], name: str = "line_no",
                partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in ``order`` (a unique key)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    ranged = written(ranged, "numbered")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = offsets_by_group(sizes, ["_part"]).select("_part", "_offset")
    # one row per partition: the broadcast is bounded by ``n``
    numbered = ranged.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + F.col("_pos") + 1).drop("_part", "_pos", "_offset")


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Add ``name`` = 1-based position of each row within its ``keys`` group, by ``order`` (unique in the group).

    All rows are numbered over all tasks by (keys, order); a position is the
    number less its group's first.  No group is ever one task's rows.
    """
    numbered = number_rows(df, [*keys, *order], name="_no")
    first = numbered.groupBy(*keys).agg(F.min("_no").alias("_first"))
    return numbered.join(first, keys).withColumn(name, F.col("_no") - F.col("_first") + 1).drop("_no", "_first")


def running_totals(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name`` = sum of ``value`` over all rows before each row in ``order``, over all tasks.

    As :func:`number_rows`: the rows are ranged and written once, a partition
    sums up its own rows, and the partitions' totals (one row each) give their offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    ranged = written(ranged, "totals")
    earlier = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("_in", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    sizes = ranged.groupBy("_part").agg(F.sum(value).alias("_size"))
    offsets = offsets_by_group(sizes, ["_part"]).select("_part", F.col("_offset").alias("_to"))
    # one row per partition, as above
    return inner.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_in") + F.col("_to")).drop("_part", "_pos", "_in", "_to")


def sums_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, stretch: int = 1024) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the rows of the same ``keys`` with a smaller ``order`` (an integer).

    Two levels: within stretches of ``order`` first, then over the stretches'
    totals, so a hot key is dealt over many groups.
    """
    cut = df.withColumn("_s", F.floor(F.col(order) / F.lit(stretch)))
    inner = Window.partitionBy(*keys, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_s").agg(F.sum(value).alias("_of"))
    starts = totals.select(*keys, "_s", F.coalesce(F.sum("_of").over(outer), F.lit(0)).alias("_to"))
    placed = cut.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(starts, [*keys, "_s"])
    return placed.withColumn(name, F.col("_in") + F.col("_to")).drop("_s", "_in", "_to")
