"""Dense numbering of rows in a given order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.plans.scratch import Scratch

# Fixed value: monotonically_increasing_id keeps the row number in the low 33 bits.
ROW_BITS = 33


def dense_index(
    rows: DataFrame, order: Sequence[str | Column], index: str, scratch: Scratch, name: str
) -> DataFrame:
    """Adds ``index``: 0-based BIGINT position of each row in ``order``.

    Rows are range-partitioned and sorted once, and written with their place in
    their partition, so the number cannot change when a task is run again. Only
    one row per partition goes through the running sum of partition sizes.
    """
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    kept = scratch.keep(placed, name).withColumn("_slice", F.shiftright("_place", ROW_BITS))
    before = F.sum("_size").over(
        Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = (
        kept.groupBy("_slice")
        .agg(F.count("*").alias("_size"))
        .select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return kept.join(F.broadcast(slices), "_slice").select(
        *rows.columns, (place + F.col("_before")).alias(index)
    )
