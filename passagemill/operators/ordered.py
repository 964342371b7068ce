"""Ranks, neighbours and running sums within groups of any size.

A plain window sorts each group in one task. Here the order's key is cut into ranges first: the window runs within a
range, and only one row for each range is ordered within the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive positions that one range of a numeric order holds.
RANGE = 4096
#: Hex digits of a digest that name its range: 4096 ranges.
DIGITS = 3


def by_number(order: str) -> Column:
    return F.floor(F.col(order) / RANGE)


def by_digest(order: str) -> Column:
    return F.substring(F.col(order), 1, DIGITS)


def positions(rows: DataFrame, within: list[str], order: list[str], span: Column, name: str = "position") -> DataFrame:
    """Rows with their position from 0 in the order within each group. ``span`` must not decrease along the order."""
    ranged = rows.withColumn("_range", span)
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    offsets = counts.select(*within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = Window.partitionBy(*within, "_range").orderBy(*order)
    ranked = ranged.withColumn("_nth", F.row_number().over(nth)).join(offsets, [*within, "_range"])
    return ranked.withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_range", "_nth", "_before")


def running_sum(rows: DataFrame, within: list[str], order: list[str], span: Column, value: str, name: str) -> DataFrame:
    """Rows with the sum of ``value`` up to and with the row, in the order within each group, and ``<name>_all``, the group's."""
    ranged = rows.withColumn("_range", span)
    group = Window.partitionBy(*within)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*within, "_range").agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*within, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(group).alias(f"{name}_all"))
    inner = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_upto", F.sum(value).over(inner)).join(offsets, [*within, "_range"])
    return summed.withColumn(name, F.col("_before") + F.col("_upto")).drop("_range", "_upto", "_before")


def followers(rows: DataFrame, within: list[str], order: list[str], span: Column, value: str, name: str) -> DataFrame:
    """within, value and the next row's value in the order (null at the end of the group)."""
    ranged = rows.select(*within, *order, F.col(value).alias("_value"), span.alias("_range"))
    firsts = ranged.groupBy(*within, "_range").agg(F.min(F.struct(*order, "_value")).alias("_first"))
    ahead = Window.partitionBy(*within).orderBy("_range")
    nexts = firsts.select(*within, "_range", F.lead("_first._value").over(ahead).alias("_beyond"))
    inner = Window.partitionBy(*within, "_range").orderBy(*order)
    inside = ranged.withColumn("_next", F.lead("_value").over(inner)).join(nexts, [*within, "_range"])
    return inside.select(*within, F.col("_value").alias(value), F.coalesce("_next", "_beyond").alias(name))
