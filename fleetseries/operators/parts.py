"""Numbered parts of bounded size, however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetseries.session import write_table


def number_parts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """``rows`` with ``part`` (from 0): runs of ``size`` rows of a key, in order.

    Rows are dealt by ranges of (keys, order) and counted per range and key; a
    row's place is its place in its range plus the counts of the ranges before.
    So a key that holds most rows is counted by many tasks, and no window spans it.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = write_table(ranged, "ranged")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range", *keys).count()
    starts = counts.select("_range", *keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    placed = ranged.withColumn("_place", F.row_number().over(inside)).join(starts, ["_range", *keys])
    part = F.floor((F.col("_start") + F.col("_place") - 1) / size).cast("int")
    return placed.select(*rows.columns, part.alias("part"))
