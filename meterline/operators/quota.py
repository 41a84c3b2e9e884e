"""Quota readings: latest pools, current cycles, resets and switches of account."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slots import neighbour

#: Fixed values of the reset rule: least drop in points, how long a confirmation may take and how far it may rise, and
#: how near a boundary a scheduled reset lies, before and after.
LEAST_DROP, CONFIRM_SECONDS, CONFIRM_RISE = 5.0, 600, 2.0
BEFORE_SECONDS, AFTER_SECONDS = 600, 1800


def latest(observations: DataFrame, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """The last reading of each account, or of each of the given keys, such as account, pool and window."""
    order = Window.partitionBy(*keys).orderBy(F.desc("observed_at"), F.desc("event_id"))
    return observations.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


#: Fixed value: how many readings of an account are listed at most.
NEWEST = 1_000


def newest(observations: DataFrame, limit: int = NEWEST) -> DataFrame:
    """The newest readings of each account, `limit` at most."""
    order = Window.partitionBy("account").orderBy(F.desc("observed_at"), F.desc("event_id"))
    return observations.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def current_cycle(observations: DataFrame) -> DataFrame:
    """Of each account: the readings at the end that share one boundary, from the first to the last of them.

    A reading belongs to the cycle if no reading after it has another boundary: if it has the last reading's boundary, and
    comes after the last reading of any other, which are a row a boundary.
    """
    at = F.struct("observed_at", "event_id")
    bounds = observations.groupBy("account", "resets_at").agg(F.max(at).alias("_last"))
    newest_first = Window.partitionBy("account").orderBy(F.desc("_last"))
    final = bounds.select(F.col("account").alias("_account"), F.col("resets_at").alias("_final"), F.lead("_last").over(newest_first).alias("_other"), F.row_number().over(newest_first).alias("_n")).where("_n = 1")
    same = F.col("account").eqNullSafe(F.col("_account")) & F.col("resets_at").eqNullSafe(F.col("_final")) & (F.col("_other").isNull() | (at > F.col("_other")))
    own = observations.join(final, same, "left_semi")
    first, last = (lambda c: F.min_by(c, F.struct("observed_at", "event_id"))), (lambda c: F.max_by(c, F.struct("observed_at", "event_id")))
    cycle = own.groupBy("account").agg(
        first("observed_at").alias("first_at"), last("observed_at").alias("last_at"), first("used_percent").alias("first_used"), last("used_percent").alias("last_used"),
        last("resets_at").alias("resets_at"), last("window_seconds").alias("window_seconds"), F.count("*").alias("samples"),
    )
    start = F.col("resets_at") - F.make_dt_interval(secs=F.col("window_seconds").cast("decimal(18,6)"))
    return cycle.withColumn("cycle_start", start).withColumn("local_start", F.coalesce(F.greatest("cycle_start", "first_at"), F.col("first_at"))).withColumn("used_delta", F.col("last_used") - F.col("first_used"))


def cycle_usage(cycles: DataFrame, hours: DataFrame) -> DataFrame:
    """cycles with the tokens of confirmed hours since local_start and tokens for each point used."""
    from ..functions.time import local_hour

    own = cycles.select("account", local_hour("local_start").alias("since"))
    used = hours.where("quality = 'confirmed'").join(own, "account").where(F.col("local_hour") >= F.col("since")).groupBy("account").agg(F.sum("total").cast("bigint").alias("tokens"))
    return cycles.join(used, "account", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("tokens_per_percent", F.when(F.col("used_delta") > 0, F.col("tokens") / F.col("used_delta")))


def switches(epochs: DataFrame) -> DataFrame:
    """Changes of account from one row to the next of a source, ordered by (observed_at, event_id)."""
    ordered = neighbour(epochs, ["account"], ["observed_at", "event_id"], ("source_id",))
    return ordered.withColumn("before", F.col("near.account")).drop("near").where("before is not null and not (before <=> account)")


RESETS = "account string, at timestamp_ntz, event_id long, before_used double, after_used double, previous_reset timestamp_ntz, next_reset timestamp_ntz, reset_class string"


def reset_events(observations: DataFrame, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """Drops of LEAST_DROP or more below the high water, to another boundary, that a reading soon after confirms.

    There is one high water for each account, or for each of the given keys, such as account, pool and window; keys
    other than account are columns of the result. A drop that isn't confirmed leaves the high water as it was, so that
    each decision depends on those before it: the readings of a key pass in order, and all that is kept of them is the
    high water. Confirmation, which looks ahead, is the least of the readings to one boundary within CONFIRM_SECONDS.
    Readings that can change nothing, whatever the high water is, are left out before: see telling().
    """
    extra = [k for k in keys if k != "account"]
    micros = F.unix_micros(F.col("observed_at").cast("timestamp"))
    later = Window.partitionBy(*keys, "resets_at").orderBy(micros).rangeBetween(1, CONFIRM_SECONDS * 1_000_000)
    tied = Window.partitionBy(*keys, "resets_at", "observed_at").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    least = F.least(F.min("used_percent").over(later), F.min("used_percent").over(tied))
    confirmed = F.coalesce(least <= F.col("used_percent") + CONFIRM_RISE, F.lit(False))
    series = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    ordered = observations.select(*dict.fromkeys(("account", *keys)), "observed_at", "event_id", "used_percent", "resets_at", confirmed.alias("confirmed"), series.alias("series"))
    ordered = telling(ordered, *keys)
    parts = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join([f"{k} {observations.schema[k].dataType.simpleString()}" for k in extra] + [RESETS])
    return ordered.repartition(parts, "series").sortWithinPartitions("series", "observed_at", "event_id").mapInPandas(lambda batches: scan_resets(batches, extra), schema)


def telling(readings: DataFrame, *keys: str) -> DataFrame:
    """Readings that may raise the high water of a key or be a reset.

    After a reading the high water is at least that reading. So one below it that isn't confirmed is neither, and one
    equal to it, to the same boundary, does what that one did if it isn't confirmed or both are.
    """
    order = Window.partitionBy(*keys).orderBy("observed_at", "event_id")
    before = F.lag(F.struct("used_percent", "resets_at", "confirmed")).over(order)
    rows = readings.where("used_percent is not null and not isnan(used_percent)").withColumn("_before", before)
    lower = ~F.col("confirmed") & (F.col("used_percent") < F.col("_before.used_percent"))
    same = (F.col("used_percent") == F.col("_before.used_percent")) & F.col("resets_at").eqNullSafe(F.col("_before.resets_at")) & (~F.col("confirmed") | F.col("_before.confirmed"))
    return rows.where(F.col("_before").isNull() | ~(lower | same)).drop("_before")


def scan_resets(batches: Iterator[pd.DataFrame], extra: list[str]) -> Iterator[pd.DataFrame]:
    series, high = None, None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.series != series:
                series, high = r.series, None
            if pd.isna(r.used_percent):
                continue
            if high is None or r.used_percent >= high.used_percent:
                high = r
                continue
            same = r.resets_at == high.resets_at or (pd.isna(r.resets_at) and pd.isna(high.resets_at))
            if high.used_percent - r.used_percent < LEAST_DROP or same or not r.confirmed:
                continue
            due = not pd.isna(high.resets_at) and -BEFORE_SECONDS <= (r.observed_at - high.resets_at).total_seconds() <= AFTER_SECONDS
            kind = "scheduled_rollover" if due else "observed_official_reset"
            out.append((*[getattr(r, k) for k in extra], r.account, r.observed_at, r.event_id, high.used_percent, r.used_percent, high.resets_at, r.resets_at, kind))
            high = r
        yield pd.DataFrame(out, columns=[*extra, *[x.split()[0] for x in RESETS.split(", ")]])


def held_back(observations: DataFrame, epochs: DataFrame, source_id: str = "source_id") -> DataFrame:
    """observations with epoch_account and held: whether the reading waits for an epoch.

    The readings of a source are taken in order up to the first that no epoch covers; it and all after it are held, to
    be asked for again when epochs are known.
    """
    from .attribution import epoch_at

    at = F.struct("observed_at", "event_id")
    found = epoch_at(observations, epochs, "observed_at").drop("epoch_confidence")
    first = found.where("epoch_account is null").groupBy(F.col(source_id).alias("_source")).agg(F.min(at).alias("_first"))
    held = F.coalesce(at >= F.col("_first"), F.lit(False))
    return found.join(first, F.col(source_id).eqNullSafe(F.col("_source")), "left").withColumn("held", held).drop("_source", "_first")


def cards(readings: DataFrame, main: str = "main") -> DataFrame:
    """The latest reading of each account, pool and window: by account, the main pool first, longer windows first."""
    own = latest(readings, ("account", "pool_key", "window_name"))
    return own.orderBy("account", F.col("pool_key") != main, F.desc("window_seconds"), "pool_key", "window_name")
