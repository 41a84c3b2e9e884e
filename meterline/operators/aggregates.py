"""Sums of usage: raw facts, cubes, series, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import local_day, local_hour, month_key, week_key
from ..functions.tokens import MEASURES

STANDALONE, UNASSIGNED = "standalone", "unassigned"
#: Keys of the materialised cubes; a null dimension is the empty text.
DIMENSIONS = ("thread_id", "account", "project_id", "model")


def measures(count: Column | None = None, prefix: str = "", where: Column | None = None) -> list[Column]:
    """The common list: number of events and the seven sums; 0 over no rows. Overflow is an error, as ANSI sums raise."""
    pick = (lambda c: F.when(where, c)) if where is not None else (lambda c: c)
    events = F.sum(pick(count)) if count is not None else F.count(pick(F.lit(1)))
    return [F.coalesce(events, F.lit(0)).cast("bigint").alias(f"{prefix}event_count"), *[F.coalesce(F.sum(pick(F.col(m))), F.lit(0)).cast("bigint").alias(prefix + m) for m in MEASURES]]


def totals(facts: DataFrame, *keys: str | Column) -> DataFrame:
    return facts.groupBy(*keys).agg(*measures()) if keys else facts.agg(*measures())


def cube(facts: DataFrame, time: str, quality: bool = True) -> DataFrame:
    """The finest sums by local_day or local_hour and all dimensions, quality among them for sampled facts."""
    keys = [F.coalesce(d, F.lit("")).alias(d) for d in DIMENSIONS]
    return facts.groupBy(time, *keys, *(["quality"] if quality else [])).agg(*measures())


def cube_totals(cube: DataFrame, *keys: str | Column) -> DataFrame:
    own = measures(F.col("event_count"))
    return cube.groupBy(*keys).agg(*own) if keys else cube.agg(*own)


def dimension(name: str) -> Column:
    """A cube's dimension with null for none."""
    return F.nullif(F.col(name), F.lit("")).alias(name)


def in_range(facts: DataFrame, start: Column | None, end: Column | None, at: str = "source_timestamp") -> DataFrame:
    """Half-open."""
    for bound, keep in ((start, lambda b: F.col(at) >= b), (end, lambda b: F.col(at) < b)):
        facts = facts.where(keep(bound)) if bound is not None else facts
    return facts


def cube_range(cube: DataFrame, start: Column | None, end: Column | None, hourly: bool = False) -> DataFrame:
    """Whole buckets: that of the start, and up to that which holds the last moment before the end."""
    key, of = ("local_hour", local_hour) if hourly else ("local_day", local_day)
    if start is not None:
        cube = cube.where(F.col(key) >= of(start))
    return cube.where(F.col(key) <= of(end - F.expr("interval 1 microsecond"))) if end is not None else cube


def classified(rows: DataFrame, standalone: DataFrame) -> DataFrame:
    """rows with project: `standalone` for members of standalone trees, `unassigned` without a project, else the project."""
    member = standalone.select("thread_id", F.lit(True).alias("is_standalone"))
    project = F.when(F.col("is_standalone"), STANDALONE).when(F.coalesce("project_id", F.lit("")) == "", UNASSIGNED).otherwise(F.col("project_id"))
    return rows.join(member, "thread_id", "left").withColumn("project", project).drop("is_standalone")


def of_project(rows: DataFrame, project: str | None) -> DataFrame:
    """Classified rows of one project; None, an empty name and `all` are every project."""
    project = (project or "").strip()
    return rows if project in ("", "all") else rows.where(F.col("project") == project)


def bucket(grain: str) -> Column:
    day = "local_day"
    return {"day": F.col(day), "week": week_key(day), "month": month_key(day)}[grain].alias("bucket")


def pivot_by_quality(rows: DataFrame, key: str) -> DataFrame:
    """Confirmed, quarantined and unknown totals by key, and its share of all confirmed."""
    sums = [F.coalesce(F.sum(F.when(F.col("quality") == q, F.col("total"))), F.lit(0)).cast("bigint").alias(q) for q in ("confirmed", "quarantined", "unknown")]
    everything = Window.partitionBy(F.lit(0))
    return rows.groupBy(key).agg(*sums).withColumn("share", F.when(F.sum("confirmed").over(everything) > 0, F.col("confirmed") / F.sum("confirmed").over(everything)).otherwise(F.lit(0.0)))
