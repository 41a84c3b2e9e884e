"""Further registered queries: account totals and their gaps, history of accounts, readings that wait, labels and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time
from ..functions.tokens import MEASURES, valid
from ..operators import aggregates as agg
from ..operators import attribution, maintenance, official, quota
from ..sources import discovery, logs
from ..sources import ledger as source
from .catalogue import ROOTS, ROOTS_SQL, _at, _period, _threads, literal, query
from .ledger import Ledger
from .more import quota_payload_pools
from .oracle import CUBE

MS = ", ".join(MEASURES)

# --- the account total

DISPLAY = "(select cast(coalesce(sum(tokens) filter (state in ('official', 'tail', 'only')), 0) as bigint) display, count(*) filter (state = 'official') n, cast(coalesce(sum(tokens) filter (state in ('tail', 'only')), 0) as bigint) c, count(distinct account) filter (state <> 'only') k, min(state = 'official') whole from account_days)"


@query("attribution_gap_buckets", f"select before_evidence, without_evidence, display account_total, l local_tokens, display - l gap, display - l - before_evidence - without_evidence rest from (select cast(coalesce(sum(tokens) filter (first is null or o.day < first), 0) as bigint) before_evidence, cast(coalesce(sum(tokens) filter (o.day >= first and e.day is null), 0) as bigint) without_evidence from official o cross join (select min(local_day) first from eff_days where event_count > 0) left join (select distinct local_day as day from eff_days where event_count > 0) e on e.day = o.day) cross join {DISPLAY} cross join (select cast(sum(total) as bigint) l from eff_days where quality = 'confirmed')")
def attribution_gap_buckets(x: Ledger) -> DataFrame:
    evidence = x.effective_days.where("event_count > 0").select(F.col("local_day").alias("day"))
    local = agg.cube_totals(x.effective_days.where("quality = 'confirmed'"))
    return official.gap_buckets(x.official, evidence, official.display_total(x.account_days, source.DECLARED_ACCOUNTS), local)


@query("account_total_resolved", f"select display as value, case when n = 0 then 'local' when c > 0 or k <> 4 then 'reconciled' else 'official' end source, case when n = 0 or c > 0 or k <> 4 or not whole then 'lower_bound' else 'exact' end status, coalesce(whole, false) and k = 4 complete, cast(4 as bigint) known_accounts, 4 - k missing_accounts from {DISPLAY}")
def account_total_resolved(x: Ledger) -> DataFrame:
    return official.resolved_total(x.account_days, source.DECLARED_ACCOUNTS)


STARTS = {"today": "2024-01-31", "week": "2024-01-29", "month": "2024-01-01"}


@query("account_official_periods", "select account, " + ", ".join(f"cast(coalesce(sum(tokens) filter (day between '{first}' and '2024-01-31'), 0) as bigint) as \"{name}\"" for name, first in STARTS.items()) + ", cast(sum(tokens) as bigint) lifetime from official group by 1")
def account_official_periods(x: Ledger) -> DataFrame:
    """Of each account: official tokens of today, this week and this month as local days, and of all days."""
    return official.period_table(x.official, STARTS, "2024-01-31")


@query("reconstruction_status", "select count(*) filter (u % 4 = 0) pending, count(*) filter (u % 4 = 1) reconstructing, count(*) filter (u % 4 = 2) reconstructed, count(*) filter (u % 4 = 3) unrecoverable, cast(sum(n * 100 * (u % 4) // 4) as bigint) bytes_processed, cast(sum(n * 100) as bigint) bytes_total, (select cast(coalesce(sum(reconstruction_tokens), 0) as bigint) from selection where source = 'reconstruction') selected_tokens from (select user_id u, count(*) n from facts group by 1)")
def reconstruction_status(x: Ledger) -> DataFrame:
    return discovery.reconstruction_status(reconstruction_files(x), x.selection)


def reconstruction_files(x: Ledger) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in discovery.STATES]), (F.col("user_id") % 4 + 1).cast("int"))
    return x.facts.groupBy("user_id").agg((F.count("*") * 100).alias("bytes_total")).select(state.alias("status"), F.expr("bytes_total * (user_id % 4) div 4").alias("bytes_processed"), "bytes_total")


# --- accounts of the past


@query("epochs_applied_facts", "select f.event_id, coalesce(f.account, i.account) account from facts f left join inferred i on f.source_timestamp >= i.observed_from and (i.observed_to is null or f.source_timestamp < i.observed_to)")
def epochs_applied_facts(x: Ledger) -> DataFrame:
    return attribution.applied_to_facts(x.facts, x.epochs).select("event_id", "account")


def _applied(grain: str, first_floors: bool) -> str:
    floor = lambda c: f"date_trunc('{grain}', {c} + interval 8 hour)"
    up = f"case when {floor('observed_from')} = observed_from + interval 8 hour{' or observed_from = (select min(observed_from) from inferred)' if first_floors else ''} then {floor('observed_from')} else {floor('observed_from')} + interval 1 {grain} end"
    key, cube = f"local_{grain}", f"{grain}s"
    return f"select {key}, thread_id, case when d.account = '' then coalesce(i.account, '') else d.account end account, project_id, model, quality, {CUBE} from {cube} d left join (select account, {up} a, {floor('observed_to')} b from inferred) i on d.account = '' and cast(d.{key} as timestamp) >= i.a and (i.b is null or cast(d.{key} as timestamp) < i.b) group by all"


query("epochs_applied_hours", _applied("hour", False))(lambda x: attribution.applied_to_cube(x.hours, "local_hour", x.epochs))
query("epochs_applied_days", _applied("day", True))(lambda x: attribution.applied_to_cube(x.days, "local_day", x.epochs))


@query("quota_held_back", "select event_id, epoch_account, max(epoch_account is null) over (partition by thread_id order by source_timestamp, event_id) held from (select f.event_id, f.thread_id, f.source_timestamp, i.account epoch_account from facts f left join inferred i on f.source_timestamp >= i.observed_from and (i.observed_to is null or f.source_timestamp < i.observed_to) where event_type = 'signup')")
def quota_held_back(x: Ledger) -> DataFrame:
    """Quota readings of each thread's log, and which of them wait until an epoch covers them."""
    rows = x.facts.where("event_type = 'signup'").select("event_id", F.col("thread_id").alias("source_id"), F.col("source_timestamp").alias("observed_at"))
    return quota.held_back(rows, x.epochs).select("event_id", "epoch_account", "held")


# --- lists and labels


@query("quota_cards", "select account, pool_key, window_name, event_id, used_percent, window_seconds from (select *, row_number() over (partition by account, pool_key order by source_timestamp desc, event_id desc) n from (select event_id, source_timestamp, account, unnest(['main', 'extra']) pool_key, unnest(['primary', 'secondary']) window_name, unnest([case when k <= 90 then k + 10.0::double end, cast(k as double)]) used_percent, unnest([18000::bigint, 604800::bigint]) window_seconds from facts where event_type = 'signup' and account is not null)) where n = 1")
def quota_cards(x: Ledger) -> DataFrame:
    whose = x.facts.where("event_type = 'signup' and account is not null").select("event_id", "account", F.col("source_timestamp").alias("observed_at"))
    readings = quota_payload_pools(x).join(whose, "event_id")
    return quota.cards(readings).select("account", "pool_key", "window_name", "event_id", "used_percent", "window_seconds")


@query("compaction_candidates", "select event_id, local_day from facts where local_day < '2024-01-15' order by source_timestamp, event_id limit 500")
def compaction_candidates(x: Ledger) -> DataFrame:
    """The first 500 facts that compaction takes."""
    return maintenance.oldest(x.facts, "2024-01-15", 500).select("event_id", "local_day")


@query("usage_with_labels", f"select coalesce(l.label, nullif(d.project_id, ''), 'Unassigned') project_label, {CUBE} from days d left join (values ('p1', 'First'), ('p2', 'Second')) l(project_id, label) using (project_id) group by 1")
def usage_with_labels(x: Ledger) -> DataFrame:
    """Usage by a project's name; one without a name goes by its id."""
    names = x.spark.createDataFrame([("p1", "First"), ("p2", "Second")], "project_id string, label string")
    label = F.coalesce("label", agg.dimension("project_id"), F.lit("Unassigned"))
    return agg.cube_totals(agg.cube_totals(x.days, "project_id").join(names, "project_id", "left"), label.alias("project_label"))


SIDE = "select row_number() over (order by local_day) position, local_day, cast(sum(total) as bigint) total from eff_days where quality = 'confirmed' and local_day between"


@query("chart_by_position", f"select position, a.local_day current_day, a.total current_total, b.local_day previous_day, b.total previous_total from ({SIDE} '2024-01-29' and '2024-01-31' group by 2) a full join ({SIDE} '2024-01-22' and '2024-01-24' group by 2) b using (position)")
def chart_by_position(x: Ledger) -> DataFrame:
    """This week's days beside those of the week before, by position. The rows of either side are days of a period."""
    p = _period("week")

    def side(name: str, start, end) -> DataFrame:
        days = agg.cube_totals(agg.cube_range(x.effective_days.where("quality = 'confirmed'"), _at(start), _at(end)), "local_day")
        return days.select(F.row_number().over(Window.orderBy("local_day")).alias("position"), F.col("local_day").alias(f"{name}_day"), F.col("total").alias(f"{name}_total"))

    return side("current", p.start, p.end).join(side("previous", p.compare_start, p.compare_end), "position", "full_outer")


@query("window_labels", "select event_id, case when k >= 60 then '1 days' when k >= 30 then '5 hours' else k || ' minutes' end as label, strftime(source_timestamp + interval 8 hour, '%Y-%m') <> '2024-01' crosses_month, strftime(source_timestamp + interval 8 hour, '%Y') <> '2024' crosses_year from facts")
def window_labels(x: Ledger) -> DataFrame:
    """Lengths as text, and whether windows that begin at an event and end with the pinned month cross its bounds."""
    minutes = F.when(F.col("k") >= 60, 1440).when(F.col("k") >= 30, 300).otherwise(F.col("k"))
    end = literal("2024-01-31 15:59:59")
    return x.facts.select("event_id", time.duration_label(minutes).alias("label"), *[time.crosses("source_timestamp", end, "Asia/Shanghai", y).alias(n) for n, y in (("crosses_month", False), ("crosses_year", True))])


# --- sources


@query("strict_usage", f"select event_id, {MS} from (select event_id, i as input, cached_input, cache_write_input, case when k % 2 = 0 then i else 0 end cache_write_observed, output, reasoning_output, case when k % 7 = 0 then 0 else total end total from (select *, case when k % 3 = 0 then 0 else input end i from facts)) where cached_input + cache_write_input <= input and input + output = total")
def strict_usage(x: Ledger) -> DataFrame:
    """Sampled usage objects, some with numbers as text or without a total: what isn't strictly a usage is left out."""
    number = lambda name, c: F.concat(F.lit(f'"{name}":'), c.cast("string"))
    text = F.concat(F.lit('"input_tokens":"'), F.col("input"), F.lit('"'))
    parts = F.array_compact(
        F.array(
            F.when(F.col("k") % 3 == 0, text).otherwise(number("input_tokens", F.col("input"))),
            *[number(logs.USAGE[m], F.col(m)) for m in ("cached_input", "output", "reasoning_output")],
            F.when(F.col("k") % 7 != 0, number(logs.USAGE["total"], F.col("total"))),
            F.when(F.col("k") % 2 == 0, number(logs.CACHE_WRITES[0], F.col("cache_write_input"))),
        )
    )
    lines = x.facts.select("event_id", F.concat(F.lit('{"usage":{'), F.array_join(parts, ","), F.lit("}}")).alias("line"))
    return lines.select("event_id", *logs.strict_usage("$.usage")).where(valid())


@query("cursors_kept", "select 's' || user_id source, cast(count(*) * 100 as bigint) \"offset\" from facts group by user_id having max(k) < 99")
def cursors_kept(x: Ledger) -> DataFrame:
    """Cursors but for those of files that were swapped: here, those that hold a k of 99."""
    name = F.concat(F.lit("s"), "user_id").alias("source")
    cursors = x.facts.groupBy("user_id").agg((F.count("*") * 100).alias("offset")).select(name, "offset")
    return discovery.kept_cursors(cursors, x.facts.where("k >= 99").select(name))


@query("source_ids", "select thread_id, 'file-' || substr(sha256('/logs/' || thread_id), 1, 24) source_id, 'logs_' || thread_id relative_id from (select distinct thread_id from facts)")
def source_ids(x: Ledger) -> DataFrame:
    paths = x.facts.select("thread_id").distinct().select("thread_id", F.concat(F.lit("/logs/"), "thread_id").alias("path"), F.concat(F.lit("logs/"), "thread_id").alias("relative"))
    return paths.select("thread_id", discovery.source_id("path").alias("source_id"), discovery.relative_id("relative").alias("relative_id"))


@query("git_evidence_of_roots", f"select distinct r.project_id, 'host.example/o/r' || (u % 5) identity from (select case when project_id = 'p4' then '/work/p/4/x/src' when project_id is not null then '/work/p/' || substr(project_id, 2) else '/home/z' end cwd, cast(substr(thread_id, 2) as bigint) u from catalog) c join {ROOTS_SQL} on c.cwd = r.path or starts_with(c.cwd, r.path || '/')")
def git_evidence_of_roots(x: Ledger) -> DataFrame:
    remote = F.concat(F.lit("git@host.example:o/r"), F.substring("thread_id", 2, 20).cast("bigint") % 5, F.lit(".git"))
    threads = _threads(x).withColumn("git_origin", remote)
    return attribution.evidence_of_roots(threads, x.spark.createDataFrame(ROOTS, "path string, project_id string"))


# --- changes to the ledger


@query("usage_upserts", "select thread_id, arg_max(total, event_id) total, max(event_id) event_id from facts group by 1")
def usage_upserts(x: Ledger) -> DataFrame:
    """A thread's last known usage: what is written later replaces what was there."""
    rows = x.facts.select("thread_id", "total", "event_id")
    return maintenance.upserted(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "thread_id", "event_id")


@query("coverage_repaired", "select event_id, least(cache_write_observed + k, input) cache_write_observed from facts")
def coverage_repaired(x: Ledger) -> DataFrame:
    """Facts whose observed cache writes, here too large by k, are brought down to their input."""
    broken = x.facts.withColumn("cache_write_observed", (F.col("cache_write_observed") + F.col("k")).cast("bigint"))
    return maintenance.capped_coverage(broken).select("event_id", "cache_write_observed")
