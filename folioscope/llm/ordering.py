"""Global positions and running totals without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.cluster import settle

#: Word separators of every operator here: ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def running_total(
    df: DataFrame, order: Sequence[Column], total: str, value: Column
) -> DataFrame:
    """Add `total` (long): the sum of `value` over all rows that come before in `order`.

    The rows are range-partitioned by `order`, so a group that holds a third of them
    still spreads as long as the columns after its key differ. One small row per
    partition is summed across partitions; within each a window runs. Null values
    count as 0. Rows that tie in all of `order` come in any order.
    """
    # Dealing by range reads its input twice, so what is computed is settled first.
    valued = settle(df.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))))
    placed = settle(
        valued.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    )
    sums = placed.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    # One row for each shuffle partition, which bounds this window and the broadcast.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    within = (
        Window.partitionBy("_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum("_value").over(within), F.lit(0))
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_range")
        .withColumn(total, F.col("_start") + F.col("_inside"))
        .drop("_range", "_value", "_start", "_inside")
    )


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Up to `rows` distinct values of the column `key`: those with the least hash.

    Copies count once. Values beyond twice the expected bound go at once, so few meet in
    the task that takes the least, however many partitions there are; where fewer than
    `rows` lie below the bound, all are taken into account.
    """
    order = F.xxhash64(F.lit(8_001), key)
    of = df.agg(F.approx_count_distinct(order)).first()[0]
    values = df.select(key)
    if of > 2 * rows:
        bound = F.lit(-(2**63) + int(2 * rows / of * 2**64))
        low = settle(values.where(order < bound).distinct())
        if low.count() >= rows:
            return low.orderBy(order, key).limit(rows)
    return values.distinct().orderBy(order, key).limit(rows)
