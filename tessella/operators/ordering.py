"""Numbering a whole table in order without passing it through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import durable, unused


def _ranges(df: DataFrame, order: list) -> tuple[DataFrame, DataFrame, str, str]:
    """The table cut into ranges of the order and stored, and how many rows come before each range."""
    part, before = unused(df, "part", "before")
    cut = durable(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = cut.groupBy(part).agg(F.count("*").alias("n"))  # as many rows as there are partitions
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    return cut, sizes.select(part, (F.sum("n").over(w) - F.col("n")).alias(before)), part, before


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """`df` with the place of each row, from 1."""
    cut, offsets, part, before = _ranges(df, order)
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return cut.withColumn(name, own).join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def share_below(df: DataFrame, column: str, name: str = "percentile") -> DataFrame:
    """`df` with the share of the other rows that are strictly below; equal values lie in one range."""
    cut, offsets, part, before = _ranges(df, [column])
    total = cut.count()
    below = F.rank().over(Window.partitionBy(part).orderBy(column)) - 1
    out = cut.withColumn(name, below).join(F.broadcast(offsets), part)
    return out.withColumn(name, F.when(F.lit(total) > 1, (F.col(name) + F.col(before)) / F.lit(max(total - 1, 1))).otherwise(0.0)).drop(part, before)
