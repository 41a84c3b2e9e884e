"""Places in an order of all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoint import settle


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df, settled, with each row's place from 0 in an order of all rows.

    Rows are dealt by ranges and counted range by range, so that no task has more than its range; the order should end
    in a column that tells equal rows apart, or they are one range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    first = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row a shuffle partition
    before = ranges.select("_range", (F.coalesce(F.sum("_n").over(first), F.lit(0)) - F.col("_first")).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")
