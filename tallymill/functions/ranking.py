"""Ranks over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import checkpointed

# monotonically_increasing_id puts the partition number above this many bits.
ROW_BITS = 33


def with_position(df: DataFrame, *order_by: str, name: str = "position") -> DataFrame:
    """Add each row's 1-based place in the total order of `order_by`, and `name`_count.

    `order_by` must identify a row. The sort is range partitioned, so a value shared
    by many rows is split by the later columns. Its result is checkpointed because
    row ids are only stable once the partitions are fixed.
    """
    place = "_place"
    ordered = checkpointed(df.orderBy(*order_by).withColumn(place, F.monotonically_increasing_id()))
    block = F.shiftright(place, ROW_BITS)
    # One row per sorted partition, so this window stays small at any table size.
    blocks = ordered.groupBy(block.alias("_block")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_block",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias(f"{name}_count"),
    )
    within = F.col(place).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        ordered.withColumn("_block", block)
        .join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_block", "_before", place)
    )
