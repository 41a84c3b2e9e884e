"""Arithmetic of usage measures: seven whole numbers a fact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = ("input", "cached_input", "cache_write_input", "cache_write_observed", "output", "reasoning_output", "total")


def uncached() -> Column:
    return F.greatest(F.col("input") - F.col("cached_input") - F.col("cache_write_input"), F.lit(0))


def coverage() -> Column:
    """Share of input of which cache writes were observed, within 0 and 1; 0 without input."""
    return F.when(F.col("input") == 0, F.lit(0.0)).otherwise(F.least(F.greatest(F.col("cache_write_observed") / F.col("input"), F.lit(0.0)), F.lit(1.0)))


def violations() -> dict[str, Column]:
    """What a confirmed fact mustn't be, by rule. Differences can't overflow as no measure is negative."""
    return {
        "cache_exceeds_input": F.col("cached_input") > F.col("input") - F.col("cache_write_input"),
        "observed_exceeds_input": F.col("cache_write_observed") > F.col("input"),
        "total_differs": F.col("input") != F.col("total") - F.col("output"),
        "reasoning_exceeds_output": F.col("reasoning_output") > F.col("output"),
        "negative": F.least(*MEASURES) < 0,
    }


def valid(prefix: str = "") -> Column:
    """Whether the seven measures, named with a prefix, are a possible usage."""
    c = {m: F.col(prefix + m) for m in MEASURES}
    return (
        (c["cached_input"] + c["cache_write_input"] <= c["input"])
        & (c["cache_write_observed"] <= c["input"])
        & (c["input"] + c["output"] == c["total"])
        & (c["reasoning_output"] <= c["output"])
    )


def percent_delta(current: Column, previous: Column) -> Column:
    return F.when(previous > 0, (current - previous) / previous)


def status(percent: Column) -> Column:
    return F.when(percent >= 90, "critical").when(percent >= 72, "warning").otherwise("normal")


def freshness(lag_seconds: Column) -> Column:
    return F.when(lag_seconds <= 120, "fresh").when(lag_seconds <= 600, "delayed").otherwise("stale")


def window_kind(seconds: Column) -> Column:
    """Of a quota: weekly from 6 to 8 days, short up to a day, else custom."""
    return F.when(seconds.isNull(), "unknown").when(seconds.between(6 * 86400, 8 * 86400), "weekly").when(seconds <= 86400, "short").otherwise("custom")


def remaining_percent(used: Column) -> Column:
    return F.least(F.greatest(100 - used, F.lit(0.0)), F.lit(100.0))


def official_freshness(lag_seconds: Column) -> Column:
    return F.when(lag_seconds <= 900, "fresh").otherwise("stale")


def quota_stale(lag_seconds: Column) -> Column:
    return lag_seconds > 600


#: The largest count: sums for display stop there, those of a ledger are an error.
MOST = (1 << 63) - 1


def saturating(exact: Column) -> Column:
    """A sum or difference in decimals of 38 digits as a count: none below 0, none above MOST."""
    return F.least(F.greatest(exact, F.lit(0).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")


def saturating_add(a: Column, b: Column) -> Column:
    return saturating(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"))


def saturating_sub(a: Column, b: Column) -> Column:
    return saturating(a.cast("decimal(38,0)") - b.cast("decimal(38,0)"))
