"""The ledger's inputs: usage facts and dimensions, taken from the events table by a fixed mapping.

Each function takes the events and returns one relation of the ledger as a DataFrame. Times are UTC without a zone.
The same relations in DuckDB SQL are in `plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import local_day, local_hour

#: The pinned time of all queries, and the offset of cube keys in hours.
NOW = "2024-01-31 00:00:00"
#: The measures of a usage fact.
MEASURES = ("input", "cached_input", "cache_write_input", "cache_write_observed", "output", "reasoning_output", "total")
#: Accounts that the user says there are.
DECLARED_ACCOUNTS = 4


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def facts(events: DataFrame) -> DataFrame:
    """Usage facts sampled per call: one row for each event."""
    u, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("int")
    c = F.round(F.col("value") * 100).cast("bigint")
    base = events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("source_timestamp"), u.alias("user_id"), k.alias("k"), "event_type", c.alias("c"))
    fifth = F.expr("c div 5")
    rows = base.withColumn("output", fifth).withColumn("input", F.col("c") - F.col("output"))
    written = (F.col("k") % 2) == 0
    return rows.select(
        "event_id",
        "source_timestamp",
        F.concat(F.lit("t"), u).alias("thread_id"),
        parent(u).alias("parent_thread_id"),
        depth(u).alias("depth"),
        F.when(u % 7 != 0, F.concat(F.lit("p"), u % 7)).alias("project_id"),
        F.element_at(F.array(F.lit("acct-a"), F.lit("acct-b"), F.lit("acct-c"), F.lit(None).cast("string")), (u % 4 + 1).cast("int")).alias("account"),
        F.when(F.col("k") % 10 != 9, F.concat(F.lit("m"), F.col("k") % 3)).alias("model"),
        F.when(F.col("event_type") == "error", "quarantined").when(F.col("event_type") == "signup", "unknown").otherwise("confirmed").alias("quality"),
        "input",
        F.expr("input div 2").alias("cached_input"),
        F.when(written, F.expr("input div 10")).otherwise(F.lit(0)).cast("bigint").alias("cache_write_input"),
        F.when(written, F.col("input")).otherwise(F.lit(0)).cast("bigint").alias("cache_write_observed"),
        "output",
        F.expr("output div 3").alias("reasoning_output"),
        F.col("c").alias("total"),
        "k",
        "event_type",
        "user_id",
        local_day("source_timestamp").alias("local_day"),
        local_hour("source_timestamp").alias("local_hour"),
    )


def parent(u: Column) -> Column:
    five = u % 5
    return F.when((u % 37 == 36) | (five == 0), F.lit(None)).when(five <= 2, F.concat(F.lit("t"), u - five)).otherwise(F.concat(F.lit("t"), u - 1))


def depth(u: Column) -> Column:
    five = u % 5
    return F.when(u % 37 == 36, F.lit(1)).when(five == 0, F.lit(0)).when(five <= 2, F.lit(1)).otherwise(five - 1).cast("int")


def reconstructed(facts: DataFrame) -> DataFrame:
    """Facts of the second source, taken from cumulative counters: confirmed facts, some missing, somewhat larger."""
    more = F.col("input") + F.col("k")
    return (
        facts.where("quality = 'confirmed' and k % 4 <> 3")
        .withColumn("total", F.col("total") + F.col("k"))
        .withColumn("cache_write_observed", F.when(F.col("cache_write_observed") > 0, more).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("input", more.cast("bigint"))
    )


def catalog(facts: DataFrame) -> DataFrame:
    """The thread dimension: present if the thread had an event in the last 20 days."""
    return (
        facts.groupBy("thread_id", "parent_thread_id", "depth", "project_id")
        .agg(F.min("source_timestamp").alias("created_at"), F.max("source_timestamp").alias("updated_at"))
        .withColumn("present", F.col("updated_at") >= now() - F.expr("interval 20 days"))
        .withColumn("source_kind", F.lit("native"))
    )


def official_days(facts: DataFrame) -> DataFrame:
    """(account, day, tokens): daily totals of the external ledger, as far as it covers an account."""
    day = F.to_date("local_day")
    amount = F.when(F.dayofmonth(day) % 3 != 0, F.col("total")).when(F.col("event_type").isin("click", "purchase"), F.col("total")).otherwise(F.lit(0))
    covered = ((F.col("account") == "acct-a") & (F.col("local_day") <= "2024-01-25")) | ((F.col("account") == "acct-b") & F.col("local_day").between("2024-01-05", "2024-01-20"))
    return (
        facts.where("quality = 'confirmed'")
        .where(covered)
        .groupBy("account", "local_day")
        .agg((F.sum(amount) + F.when(F.dayofmonth(F.to_date("local_day")) % 3 == 2, F.lit(5000)).otherwise(F.lit(0))).cast("bigint").alias("tokens"))
        .withColumnRenamed("local_day", "day")
    )


def counters(facts: DataFrame) -> DataFrame:
    """(thread_id, source_timestamp, event_id, measures, reset): readings of cumulative counters.

    A thread's counter starts anew where k = 0; a view repeats the reading before it, other events add theirs.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("thread_id").orderBy("source_timestamp", "event_id")
    rows = facts.withColumn("epoch", F.sum((F.col("k") == 0).cast("int")).over(order))
    inside = Window.partitionBy("thread_id", "epoch").orderBy("source_timestamp", "event_id")
    added = [F.sum(F.when(F.col("event_type") != "view", F.col(m)).otherwise(F.lit(0))).over(inside).cast("bigint").alias(m) for m in MEASURES]
    return rows.select("thread_id", "source_timestamp", "event_id", "epoch", *added)


def quota_observations(facts: DataFrame) -> DataFrame:
    """(account, observed_at, event_id, used_percent, window_seconds, resets_at): readings of a five-day quota."""
    days = F.datediff(F.col("source_timestamp").cast("date"), F.lit("2024-01-01").cast("date"))
    mark = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(days / 5) * 5 + 5).cast("int")).cast("timestamp_ntz")
    return facts.where("event_type = 'signup' and account is not null").select(
        "account", F.col("source_timestamp").alias("observed_at"), "event_id", F.col("k").cast("double").alias("used_percent"), F.lit(432000).cast("bigint").alias("window_seconds"), mark.alias("resets_at")
    )


def auth_markers(facts: DataFrame) -> DataFrame:
    """(event_id, observed_at, kind, account): logout, login and account markers of the request log."""
    kind = F.when(F.col("k") <= 2, "logout").when(F.col("k") <= 5, "login_success").otherwise("account_seen")
    return facts.where("event_type = 'error' and k < 10").select("event_id", F.col("source_timestamp").alias("observed_at"), kind.alias("kind"), F.when(F.col("k") >= 6, F.col("account")).alias("account"))
