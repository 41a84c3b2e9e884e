"""Reconciliation with an external ledger of daily totals, and what it leaves unexplained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import month_key, week_key
from ..functions.tokens import uncached

#: Statuses of a day from best to worst.
STATUSES = ("exact_official", "local_tail", "unknown", "local_only_account")


def latest_days(snapshots: DataFrame) -> DataFrame:
    """(account, day, tokens): revisable buckets, the last observed wins."""
    return snapshots.groupBy("account", "day").agg(F.max_by("tokens", F.struct("observed_at", "tokens")).alias("tokens"))


def as_of(snapshots: DataFrame, seen: Column) -> DataFrame:
    """(account, day, tokens): the ledger as it was known at a time; snapshots has account, day, observed_at and tokens."""
    return latest_days(snapshots.where(F.col("observed_at") <= seen))


def revised(snapshots: DataFrame, earlier: Column, later: Column) -> DataFrame:
    """(account, day, before, after, delta): the days of which the ledger says something else at the later time.

    Both states come from one pass over the snapshots; a day that wasn't there is null, and counts as 0 in the delta.
    """
    at = lambda seen: F.max_by(F.when(F.col("observed_at") <= seen, F.col("tokens")), F.when(F.col("observed_at") <= seen, F.struct("observed_at", "tokens")))
    days = snapshots.where(F.col("observed_at") <= later).groupBy("account", "day").agg(at(earlier).alias("before"), at(later).alias("after"))
    return days.where("not (before <=> after)").withColumn("delta", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))


def period_delta(days: DataFrame, current: tuple[str, str], previous: tuple[str, str]) -> DataFrame:
    """(total, previous, delta, delta_percent): the ledger's tokens of two ranges of days, each with its last day, in one pass.

    A range of which no account has a covered day has no total; without both there is no delta, and no percentage of 0.
    """
    covered = days.groupBy("account").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    has = lambda r: F.max((F.col("a") <= r[1]) & (F.col("b") >= r[0]))
    some = covered.agg(has(current).alias("has_total"), has(previous).alias("has_previous"))
    sum_ = lambda r: F.coalesce(F.sum(F.when(F.col("day").between(*r), F.col("tokens"))), F.lit(0)).cast("bigint")
    rows = days.agg(sum_(current).alias("total"), sum_(previous).alias("previous")).crossJoin(some)  # two single rows
    rows = rows.select(F.when(F.col("has_total"), F.col("total")).alias("total"), F.when(F.col("has_previous"), F.col("previous")).alias("previous"))
    rows = rows.withColumn("delta", F.col("total") - F.col("previous"))
    return rows.withColumn("delta_percent", F.when(F.col("previous") > 0, F.col("delta") / F.col("previous")))


def coverage(days: DataFrame) -> DataFrame:
    return days.groupBy("account").agg(F.min("day").alias("covered_from"), F.max("day").alias("covered_through"), F.count("*").alias("days"), F.sum("tokens").cast("bigint").alias("tokens"), F.max("tokens").alias("peak"))


def common_coverage(covered: DataFrame, expected: int) -> DataFrame:
    """(covered_from, covered_through) of all expected accounts: the latest start, the earliest end; null unless all are covered."""
    all_ = F.count("*") == expected
    return covered.agg(F.when(all_, F.max("covered_from")).alias("covered_from"), F.when(all_, F.min("covered_through")).alias("covered_through"))


def zero_filled(days: DataFrame, window: DataFrame, start: str, end: str) -> DataFrame:
    """(day, tokens): sums by day within [start, end), with 0 on days of the common coverage that have no bucket."""
    known = days.where((F.col("day") >= start) & (F.col("day") < end)).groupBy("day").agg(F.sum("tokens").cast("bigint").alias("tokens"))
    first, last = F.greatest("covered_from", F.lit(start)).cast("date"), F.least("covered_through", F.date_sub(F.lit(end).cast("date"), 1).cast("string")).cast("date")
    grid = window.where("covered_from is not null").select(first.alias("a"), last.alias("b")).where("a <= b").select(F.explode(F.sequence("a", "b")).alias("day")).select(F.col("day").cast("string"))
    return known.join(grid, "day", "full_outer").select("day", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


def account_days(accounts: DataFrame, start: str, end: str, official: DataFrame, local: DataFrame, covered: DataFrame) -> DataFrame:
    """(account, day, state, tokens): each account on each day of [start, end): official, tail, only or gap.

    Within coverage a day without bucket is 0. After it usage is a local tail, before it a gap, without any coverage
    local only. The grid has accounts times days rows, both bounded by the request.
    """
    dates = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))
    grid = accounts.select("account").distinct().select("account", F.explode(dates).alias("day")).withColumn("day", F.col("day").cast("string"))
    state = F.when(F.col("covered_from").isNull(), "only").when(F.col("day").between(F.col("covered_from"), F.col("covered_through")), "official").when(F.col("day") > F.col("covered_through"), "tail").otherwise("gap")
    return (
        grid.join(covered.select("account", "covered_from", "covered_through"), "account", "left")
        .join(official.select("account", "day", F.col("tokens").alias("official")), ["account", "day"], "left")
        .join(local.select("account", "day", F.col("tokens").alias("local")), ["account", "day"], "left")
        .select("account", "day", state.alias("state"), F.coalesce(F.when(state == "official", F.col("official")).otherwise(F.col("local")), F.lit(0)).cast("bigint").alias("tokens"))
    )


def reconciled(days: DataFrame, known_accounts: int) -> DataFrame:
    """Of each day: value, its official, tail and local-only parts, status and number of covered accounts."""
    part = lambda *s: F.coalesce(F.sum(F.when(F.col("state").isin(*s), F.col("tokens"))), F.lit(0)).cast("bigint")
    has = lambda s: F.max(F.col("state") == s)
    covered = F.count(F.when(F.col("state") == "official", 1))
    gap = has("gap") | (F.count("*") < known_accounts)
    status = F.when(covered == known_accounts, STATUSES[0]).when(has("only"), STATUSES[3]).when(gap, STATUSES[2]).when(has("tail"), STATUSES[1]).otherwise(STATUSES[2])
    return days.groupBy("day").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("value"),
        part("official").alias("official_tokens"),
        part("tail").alias("local_tail_tokens"),
        part("only", "gap").alias("local_only_tokens"),
        status.alias("status"),
        covered.alias("covered_accounts"),
        F.lit(known_accounts).cast("bigint").alias("known_accounts"),
    )


def by_grain(days: DataFrame, grain: str) -> DataFrame:
    """Reconciled days by week or month: sums, the worst status, the least covered accounts."""
    key = {"week": week_key("day"), "month": month_key("day")}[grain]
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("value", "official_tokens", "local_tail_tokens", "local_only_tokens")]
    return days.groupBy(key.alias("bucket")).agg(*sums, F.max_by("status", rank).alias("status"), F.min("covered_accounts").alias("covered_accounts"), F.max("known_accounts").alias("known_accounts"))


def display_total(days: DataFrame, known_accounts: int) -> DataFrame:
    """The shown total: official plus the local complement, its kind, and whether it is a lower bound.

    days are account days; accounts without coverage and days after coverage make the complement.
    """
    sum_ = lambda *s: F.coalesce(F.sum(F.when(F.col("state").isin(*s), F.col("tokens"))), F.lit(0)).cast("bigint")
    complete = F.countDistinct(F.when(F.col("state") != "only", F.col("account"))) == known_accounts
    rows = days.agg(sum_("official").alias("official_tokens"), (sum_("tail", "only")).alias("complement_tokens"), F.count(F.when(F.col("state") == "official", 1)).alias("n"), complete.alias("complete"))
    kind = F.when(F.col("n") == 0, "local_lower_bound").when((F.col("complement_tokens") > 0) | ~F.col("complete"), "official_plus_local_tail_lower_bound").otherwise("official")
    return rows.select("official_tokens", "complement_tokens", (F.col("official_tokens") + F.col("complement_tokens")).alias("display_tokens"), kind.alias("kind"), (kind != "official").alias("is_lower_bound"))


def apportioned(rows: DataFrame, group: list[str], order: list[str], weight: str, target: str) -> DataFrame:
    """rows with allocated: shares of the group's target by weight, whole numbers that add up to it.

    The quotient first; what is left goes by the largest remainder, ties in the given order. Products are decimals of
    38 digits; a group without weight gets 0.
    """
    inside = Window.partitionBy(*group)
    sum_ = F.sum(F.col(weight).cast("decimal(20,0)")).over(inside)
    product = F.col(weight).cast("decimal(19,0)") * F.col(target).cast("decimal(19,0)")
    rest = product % F.col("_sum").cast("decimal(38,0)")
    quotient = ((product - rest) / F.col("_sum").cast("decimal(38,0)")).cast("decimal(20,0)").cast("bigint")
    ranked = rows.withColumn("_sum", sum_).withColumn("_rest", F.when(F.col("_sum") > 0, rest)).withColumn("_base", F.coalesce(F.when(F.col("_sum") > 0, quotient), F.lit(0)))
    left = F.col(target) - F.sum("_base").over(inside)
    place = F.row_number().over(inside.orderBy(F.desc("_rest"), *order))
    extra = F.when((F.col("_sum") > 0) & (place <= left), 1).otherwise(0)
    return ranked.withColumn("allocated", (F.col("_base") + extra).cast("bigint")).drop("_sum", "_rest", "_base")


COMPONENTS = ("cached", "cache_write", "uncached", "reasoning", "other_output")


def components() -> list[Column]:
    left = F.greatest(F.col("input") - F.col("cached_input"), F.lit(0))
    return [
        F.least("cached_input", "input").alias(COMPONENTS[0]),
        F.least(F.col("cache_write_input"), left).alias(COMPONENTS[1]),
        uncached().alias(COMPONENTS[2]),
        F.least("reasoning_output", "output").alias(COMPONENTS[3]),
        F.greatest(F.col("output") - F.col("reasoning_output"), F.lit(0)).alias(COMPONENTS[4]),
    ]


def residual(local: DataFrame, official: DataFrame) -> DataFrame:
    """local rows of account days whose usage exceeds the official bucket, with the excess apportioned over components.

    local has account, day, project, model, event_count and the measures. Days without a bucket are left out. Rows are
    ordered by project and model within an account day; each has its five components in turn.
    """
    inside = Window.partitionBy("account", "day")
    aligned = local.join(official.select("account", "day", F.col("tokens").alias("official")), ["account", "day"])
    excess = aligned.withColumn("residual", F.greatest(F.sum("total").over(inside) - F.col("official"), F.lit(0))).where("residual > 0")
    parts = excess.select("*", *components())
    total = sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0]))
    parts = parts.withColumn("target", F.least("residual", F.sum(total).over(inside)).cast("bigint"))
    pairs = F.array(*[F.struct(F.lit(i).alias("part"), F.col(c).alias("weight")) for i, c in enumerate(COMPONENTS)])
    long = parts.select("account", "day", "project", "model", "event_count", "cache_write_observed", "target", F.explode(pairs).alias("x")).select("*", "x.part", "x.weight").drop("x")
    split = apportioned(long, ["account", "day"], ["project", "model", "part"], "weight", "target")
    part = [F.sum(F.when(F.col("part") == i, F.col("allocated"))).cast("bigint").alias(c) for i, c in enumerate(COMPONENTS)]
    back = split.groupBy("account", "day", "project", "model", "event_count", "cache_write_observed").agg(*part)
    put = F.col("cached") + F.col("cache_write") + F.col("uncached")
    out = F.col("reasoning") + F.col("other_output")
    return back.select(
        "account", "day", "project", "model", "event_count",
        put.alias("input"), F.col("cached").alias("cached_input"), F.col("cache_write").alias("cache_write_input"),
        F.when(F.col("cache_write_observed") > 0, put).otherwise(F.lit(0)).alias("cache_write_observed"),
        out.alias("output"), F.col("reasoning").alias("reasoning_output"), (put + out).alias("total"),
    ).where("total > 0")


def alignment(local: DataFrame, official: DataFrame, captured: DataFrame) -> DataFrame:
    """Counts and sums of the account days of captured accounts: aligned, in excess, without a bucket."""
    days = local.groupBy("account", "day").agg(F.sum("total").cast("bigint").alias("local")).join(captured.select("account").distinct(), "account", "left_semi")
    both = days.join(official.select("account", "day", F.col("tokens").alias("official")), ["account", "day"], "left")
    count = lambda c: F.count(F.when(c, 1))
    sum_ = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    known = F.col("official").isNotNull()
    return both.agg(
        count(known).alias("aligned_days"),
        count(known & (F.col("local") > F.col("official"))).alias("excess_days"),
        count(~known).alias("excluded_days"),
        sum_(F.when(known, F.greatest(F.col("local") - F.col("official"), F.lit(0)))).alias("raw_residual"),
        sum_(F.when(known, F.col("local"))).alias("local_tokens"),
        sum_("official").alias("official_tokens"),
        sum_(F.when(known, F.least("local", "official"))).alias("capped_tokens"),
    )


def gap_buckets(official: DataFrame, evidence: DataFrame, display: DataFrame, local: DataFrame) -> DataFrame:
    """One row: what of the gap between the shown account total and local usage has which cause.

    official has day and tokens, evidence the days with any local evidence, display and local one row each. Official
    days before the first evidence, later ones without evidence, and the rest, which may be negative, add up to the gap.
    """
    first = evidence.agg(F.min("day").alias("first"))
    days = official.groupBy("day").agg(F.sum("tokens").alias("tokens"))
    known = days.join(evidence.select("day").distinct().withColumn("seen", F.lit(True)), "day", "left").crossJoin(first)  # one row
    early = F.coalesce(F.col("day") < F.col("first"), F.lit(True))
    part = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0)).cast("bigint").alias(name)
    parts = known.agg(part(early, "before_evidence"), part(~early & F.col("seen").isNull(), "without_evidence"))
    rows = parts.crossJoin(display.select(F.col("display_tokens").alias("account_total"))).crossJoin(local.select(F.col("total").alias("local_tokens")))  # single rows
    return rows.withColumn("gap", F.col("account_total") - F.col("local_tokens")).withColumn("rest", F.col("gap") - F.col("before_evidence") - F.col("without_evidence"))


def resolved_total(days: DataFrame, known_accounts: int) -> DataFrame:
    """The account total as a metric: value, source, status and how many known accounts the external ledger covers.

    It is exact only if it has no local part and every known account is covered on all of its days.
    """
    shown = display_total(days, known_accounts)
    covered = F.countDistinct(F.when(F.col("state") != "only", F.col("account")))
    cover = days.agg(covered.alias("covered"), (F.coalesce(F.min(F.col("state") == "official"), F.lit(False)) & (covered == known_accounts)).alias("complete"))
    source = F.when(F.col("kind") == "official", "official").when(F.col("kind") == "official_plus_local_tail_lower_bound", "reconciled").otherwise("local")
    status = F.when(F.col("display_tokens").isNull(), "unknown").when(F.col("is_lower_bound") | ~F.col("complete"), "lower_bound").otherwise("exact")
    rows = shown.crossJoin(cover)  # two single rows
    return rows.select(F.col("display_tokens").alias("value"), source.alias("source"), status.alias("status"), "complete", F.lit(known_accounts).cast("bigint").alias("known_accounts"), (F.lit(known_accounts) - F.col("covered")).alias("missing_accounts"))


def period_table(days: DataFrame, starts: dict[str, str], end: str) -> DataFrame:
    """Of each account: the tokens of each period, from its first day up to `end`, and of all days."""
    part = lambda first: F.coalesce(F.sum(F.when(F.col("day").between(first, end), F.col("tokens"))), F.lit(0)).cast("bigint")
    return days.groupBy("account").agg(*[part(first).alias(name) for name, first in starts.items()], F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("lifetime"))
