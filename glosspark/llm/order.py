"""Places in an order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.session import cut


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 in its group, and ``m``, the group's rows; ``group`` holds no nulls.

    Ranges of (group, order) are dealt out by sampling and sorted, so a hot group spreads over many tasks; a row's place is its place
    in the range, and the rows of its group in the ranges before (one number per range and group) are added. Rows that
    ``order`` leaves equal have places of their own next to each other.
    """
    laid = cut(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_range", F.shiftright("_at", 33))
    sums = laid.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_r")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    sums = sums.withColumn("_before", F.expr("sum(_n) OVER (PARTITION BY _group ORDER BY _r)") - F.col("_n")).withColumn("m", F.expr("sum(_n) OVER (PARTITION BY _group)"))
    placed = laid.join(sums, (F.col(group) == F.col("_group")) & (F.col("_range") == F.col("_r")))
    return placed.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_range", "_group", "_r", "_first", "_n", "_before")
