"""Neighbours in time order without a window over all rows: windows of an hour, and one over the hours' ends.

The ends are two rows an hour, whatever the number of rows. All is windows over one read of the rows, so that these
operations can follow each other without a plan that doubles at each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hour_slot(at: str) -> Column:
    """The number of the hour that holds a time; null for none."""
    return F.unix_date(F.to_date(at)) * 24 + F.hour(at)


def _marked(rows: DataFrame, order: list[str], keys: tuple[str, ...]) -> DataFrame:
    """rows with _slot, and whether they are an hour's _first and _last in order."""
    rows = rows.withColumn("_slot", hour_slot(order[0]))
    hour = Window.partitionBy(*keys, "_slot").orderBy(*order)
    return rows.select("*", F.lag(F.lit(1)).over(hour).isNull().alias("_first"), F.lead(F.lit(1)).over(hour).isNull().alias("_last"))


def _ends(keys: tuple[str, ...]) -> Window:
    """A window over the ends of all hours, in order; other rows stay in their hours."""
    end = F.col("_first") | F.col("_last")
    return Window.partitionBy(*keys, end, F.when(~end, F.col("_slot"))).orderBy("_slot", "_last", F.desc("_first"))


def neighbour(rows: DataFrame, values: list[str], order: list[str], keys: tuple[str, ...] = (), after: bool = False) -> DataFrame:
    """rows with `near`: the values, as a struct, of the row before (or after) in order, among those of equal keys.

    order begins with a time, nulls first. An hour's first (last) row takes what the nearest other hour ends (begins) with.
    """
    step, outermost = (F.lead, "_last") if after else (F.lag, "_first")
    own = step(F.struct(*values)).over(Window.partitionBy(*keys, "_slot").orderBy(*order))
    found = _marked(rows, order, keys).withColumn("_own", own)
    beyond = step(F.struct(*values)).over(_ends(keys))
    return found.withColumn("near", F.when(F.col(outermost), beyond).otherwise(F.col("_own"))).drop("_slot", "_first", "_last", "_own")


def carried(rows: DataFrame, values: dict[str, str], order: list[str]) -> DataFrame:
    """rows with new columns: of each column of values, under its name there, the last value that isn't null, at or before
    each row in order; order begins with a time. Rows may be equal in order: they get the same, and as each sort may
    put them otherwise, what an hour begins with is taken from the row that was marked, not from the first one met."""
    hour = Window.partitionBy("_slot").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_slot")
    before = _ends(()).rowsBetween(Window.unboundedPreceding, -1)
    found = _marked(rows, order, ())
    found = found.select("*", *[F.last(c, True).over(hour).alias(f"_own_{name}") for c, name in values.items()])
    found = found.select("*", *[F.last(f"_own_{name}", True).over(before).alias(f"_before_{name}") for name in values.values()])
    carry = [F.coalesce(f"_own_{name}", F.first(F.when(F.col("_first"), F.col(f"_before_{name}")), True).over(whole)).alias(name) for name in values.values()]
    return found.select(*rows.columns, *carry)
