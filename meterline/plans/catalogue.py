"""All registered queries of the ledger, each with its SQL for an engine of its own where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, time, tokens
from ..functions.tokens import MEASURES
from ..operators import aggregates as agg
from ..operators import attribution, maintenance, official, quota, trees
from ..operators.checkpoint import settle
from ..sources import ledger as source
from ..streaming import ingest, machines
from . import oracle
from .ledger import Ledger
from .oracle import CUBE, RAW, M, T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(plan: Callable[[Ledger], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: plan(Ledger(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle.sql(sql)
        return plan

    return register


def literal(at: str):
    return F.lit(at).cast("timestamp_ntz")


MS = ", ".join(MEASURES)

# --- facts and predicates


@query("facts_projection", f"select event_id, source_timestamp, thread_id, parent_thread_id, depth, project_id, account, model, quality, {MS}, greatest(input - cached_input - cache_write_input, 0) uncached, case when input = 0 then 0.0::double else least(greatest(cache_write_observed::double / input, 0), 1) end coverage, local_day, local_hour from facts")
def facts_projection(x: Ledger) -> DataFrame:
    return x.facts.select("event_id", "source_timestamp", "thread_id", "parent_thread_id", "depth", "project_id", "account", "model", "quality", *MEASURES, tokens.uncached().alias("uncached"), tokens.coverage().alias("coverage"), "local_day", "local_hour")


@query("invariant_violations", "select cast(count(*) filter (cached_input > input - cache_write_input) as bigint) cache_exceeds_input, count(*) filter (cache_write_observed > input) observed_exceeds_input, count(*) filter (input <> total - output) total_differs, count(*) filter (reasoning_output > output) reasoning_exceeds_output, count(*) filter (least(input, cached_input, cache_write_input, cache_write_observed, output, reasoning_output, total) < 0) negative from facts")
def invariant_violations(x: Ledger) -> DataFrame:
    return x.facts.agg(*[F.count(F.when(rule, 1)).alias(name) for name, rule in tokens.violations().items()])


RANGE = "source_timestamp >= timestamp '2024-01-10 06:30:00' and source_timestamp < timestamp '2024-01-20 18:45:00'"


@query("effective_time_filter", f"select event_id, account, model, total from facts where {RANGE} and account = 'acct-a' and quality = 'confirmed'")
def effective_time_filter(x: Ledger) -> DataFrame:
    rows = agg.in_range(x.facts, literal("2024-01-10 06:30:00"), literal("2024-01-20 18:45:00"))
    return rows.where("account = 'acct-a' and quality = 'confirmed'").select("event_id", "account", "model", "total")


# --- sums of raw facts


@query("raw_total", f"select {RAW} from facts")
def raw_total(x: Ledger) -> DataFrame:
    return agg.totals(x.facts)


for _name in ("model", "account", "quality"):
    query(f"raw_by_{_name}", f"select {_name}, {RAW} from facts group by 1")(lambda x, c=_name: agg.totals(x.facts, c))
query("raw_by_thread", f"select thread_id, {RAW} from facts group by 1")(lambda x: agg.totals(x.facts, "thread_id"))
query("raw_by_utc_day", f"select strftime(source_timestamp, '%Y-%m-%d') utc_day, {RAW} from facts group by 1")(lambda x: agg.totals(x.facts, time.local_day("source_timestamp", 0).alias("utc_day")))

CLASS = "case when s.thread_id is not null then 'standalone' when coalesce(f.project_id, '') = '' then 'unassigned' else f.project_id end project"


@query("raw_by_project", f"select {CLASS}, {RAW} from facts f left join standalone s using (thread_id) group by 1")
def raw_by_project(x: Ledger) -> DataFrame:
    return agg.totals(agg.classified(x.facts, x.standalone), "project")


@query("raw_of_named_project", f"select model, {RAW} from facts where project_id = 'p3' and thread_id not in (select thread_id from standalone) group by 1")
def raw_of_named_project(x: Ledger) -> DataFrame:
    return agg.totals(agg.of_project(agg.classified(x.facts, x.standalone), "p3"), "model")


# --- cubes

for _name, _sql in (("day_cube", "days"), ("hour_cube", "hours"), ("recon_day_cube", "recon_days"), ("recon_hour_cube", "recon_hours")):
    query(_name, f"select * from {_sql}")(lambda x, c=_sql: getattr(x, c))
query("cube_total", f"select {CUBE} from days")(lambda x: agg.cube_totals(x.days))
query("hour_cube_total", f"select {CUBE} from hours")(lambda x: agg.cube_totals(x.hours))
for _name, _key in (("model", "model"), ("account", "account"), ("thread", "thread_id")):
    query(f"cube_by_{_name}", f"select nullif({_key}, '') {_key}, {CUBE} from days where quality = 'confirmed' group by 1")(lambda x, c=_key: agg.cube_totals(x.days.where("quality = 'confirmed'"), agg.dimension(c)))
for _key in ("local_day", "quality"):
    query(f"cube_by_{_key.removeprefix('local_')}", f"select {_key}, {CUBE} from days group by 1")(lambda x, c=_key: agg.cube_totals(x.days, c))


@query("cube_by_project", f"select {CLASS}, {CUBE} from days f left join standalone s using (thread_id) where quality = 'confirmed' group by 1")
def cube_by_project(x: Ledger) -> DataFrame:
    return agg.cube_totals(agg.classified(x.days.where("quality = 'confirmed'"), x.standalone), "project")


@query("cube_range_whole_days", f"select {CUBE} from days where local_day between '2024-01-10' and '2024-01-21'")
def cube_range_whole_days(x: Ledger) -> DataFrame:
    return agg.cube_totals(agg.cube_range(x.days, literal("2024-01-10 06:30:00"), literal("2024-01-20 18:45:00")))


@query("hour_range_whole_hours", f"select {CUBE} from hours where local_hour between '2024-01-10T14:00' and '2024-01-21T02:00'")
def hour_range_whole_hours(x: Ledger) -> DataFrame:
    return agg.cube_totals(agg.cube_range(x.hours, literal("2024-01-10 06:30:00"), literal("2024-01-20 18:45:00"), hourly=True))


# --- series

query("series_day", f"select local_day, nullif(model, '') model, {CUBE} from days group by 1, 2")(lambda x: agg.cube_totals(x.days, "local_day", agg.dimension("model")))
query("series_hour_by_model", f"select local_hour, nullif(model, '') model, {CUBE} from eff_hours where quality = 'confirmed' group by 1, 2")(lambda x: agg.cube_totals(x.effective_hours.where("quality = 'confirmed'"), "local_hour", agg.dimension("model")))
for _grain, _trunc in (("week", "week"), ("month", "month")):
    query(f"series_{_grain}", f"select strftime(date_trunc('{_trunc}', cast(local_day as date)), '%Y-%m-%d') bucket, {CUBE} from days group by 1")(lambda x, g=_grain: agg.cube_totals(x.days, agg.bucket(g)))
ZONE = "America/New_York"


@query("series_exact_tz", f"select strftime(source_timestamp at time zone 'UTC' at time zone '{ZONE}', '%Y-%m-%d') zone_day, model, {RAW} from facts where {RANGE} group by 1, 2")
def series_exact_tz(x: Ledger) -> DataFrame:
    rows = agg.in_range(x.facts, literal("2024-01-10 06:30:00"), literal("2024-01-20 18:45:00"))
    return agg.totals(rows, time.zone_day("source_timestamp", ZONE).alias("zone_day"), "model")


@query("series_exact_tz_hour", f"select strftime(source_timestamp at time zone 'UTC' at time zone '{ZONE}', '%Y-%m-%dT%H:00') zone_hour, {RAW} from facts where {RANGE} group by 1")
def series_exact_tz_hour(x: Ledger) -> DataFrame:
    return agg.totals(agg.in_range(x.facts, literal("2024-01-10 06:30:00"), literal("2024-01-20 18:45:00")), time.zone_hour("source_timestamp", ZONE).alias("zone_hour"))


THREADS = ("t5", "t6", "t7", "t8", "t9")
THREAD_LIST = ", ".join(f"'{t}'" for t in THREADS)


@query("series_for_threads", f"select local_day, {CUBE} from days where thread_id in ({THREAD_LIST}) group by 1")
def series_for_threads(x: Ledger) -> DataFrame:
    return agg.cube_totals(x.days.where(F.col("thread_id").isin(*THREADS)), "local_day")


@query("threads_by_thread", f"select thread_id, {CUBE} from days where thread_id in ({THREAD_LIST}) group by 1")
def threads_by_thread(x: Ledger) -> DataFrame:
    return agg.cube_totals(x.days.where(F.col("thread_id").isin(*THREADS)), "thread_id")


# --- effective evidence

query("effective_selection", "select * from selection")(lambda x: x.selection)
query("effective_day_cube", f"select local_day, thread_id, account, project_id, model, quality, event_count, {MS} from eff_days")(lambda x: x.effective_days.drop("source"))
query("effective_hour_cube", f"select local_hour, thread_id, account, project_id, model, quality, event_count, {MS} from eff_hours")(lambda x: x.effective_hours.drop("source", "local_day"))
query("effective_facts", f"select event_id, source, {MS} from eff_facts")(lambda x: x.effective_facts.select("event_id", "source", *MEASURES))


@query("effective_by_project", f"select *, case when sum(total) over () > 0 then total / cast(sum(total) over () as bigint) else 0 end share from (select {CLASS}, {CUBE} from eff_days f left join standalone s using (thread_id) where quality = 'confirmed' group by 1)")
def effective_by_project(x: Ledger) -> DataFrame:
    """Usage by classified project and its share of all, largest first."""
    rows = agg.cube_totals(agg.classified(x.effective_days.where("quality = 'confirmed'"), x.standalone), "project")
    everything = F.sum("total").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("share", F.when(everything > 0, F.col("total") / everything).otherwise(F.lit(0.0))).orderBy(F.desc("total"), "project")


# --- windows of time

NOW = datetime(2024, 1, 31, tzinfo=UTC)
HEAD, TAIL = "2024-01-23 07:20:00", "2024-01-30 07:20:00"


@query("rolling7_exact", f"select {RAW} from eff_facts where quality = 'confirmed' and source_timestamp >= timestamp '{HEAD}' and source_timestamp < timestamp '{TAIL}'")
def rolling7_exact(x: Ledger) -> DataFrame:
    return agg.totals(agg.in_range(x.effective_facts.where("quality = 'confirmed'"), literal(HEAD), literal(TAIL)))


@query("rolling7_split", f"select {RAW} from eff_facts where quality = 'confirmed' and source_timestamp >= timestamp '{HEAD}' and source_timestamp < timestamp '{TAIL}'")
def rolling7_split(x: Ledger) -> DataFrame:
    """The same window from facts of the broken hours at both ends and the hour cube between."""
    head, tail = literal(HEAD), literal(TAIL)
    first, last = time.ceil_hour(head), time.floor_hour(tail)
    facts, hours = x.effective_facts.where("quality = 'confirmed'"), x.effective_hours.where("quality = 'confirmed'")
    parts = [agg.totals(agg.in_range(facts, a, b)) for a, b in ((head, first), (last, tail))]
    whole = agg.cube_totals(hours.where((F.col("local_hour") >= time.local_hour(first)) & (F.col("local_hour") < time.local_hour(last))))
    return agg.cube_totals(parts[0].unionByName(whole).unionByName(parts[1]))


def _period(label: str) -> time.Period:
    return time.resolve_period(label, "Asia/Shanghai", NOW)


def _at(moment: datetime | None):
    return None if moment is None else literal(moment.strftime("%Y-%m-%d %H:%M:%S"))


@query("rolling30_cube", f"select {CUBE} from eff_days where quality = 'confirmed' and local_day between '2024-01-01' and '2024-01-31'")
def rolling30_cube(x: Ledger) -> DataFrame:
    p = _period("rolling30")
    return agg.cube_totals(agg.cube_range(x.effective_days.where("quality = 'confirmed'"), _at(p.start), _at(p.end)))


@query("comparison_window", f"select {CUBE} from eff_days where quality = 'confirmed' and local_day between '2024-01-22' and '2024-01-24'")
def comparison_window(x: Ledger) -> DataFrame:
    """The week before, as far as this week has come."""
    p = _period("week")
    return agg.cube_totals(agg.cube_range(x.effective_days.where("quality = 'confirmed'"), _at(p.compare_start), _at(p.compare_end)))


# --- trees and the thread dimension

query("thread_catalog", f"select *, 'native' source_kind from catalog")(lambda x: x.catalog)
query("standalone_membership", "select * from standalone")(lambda x: x.standalone)
query("root_membership", "select * from member")(lambda x: x.members)
query("thread_descendants", "select thread_id, min(d) relative_depth from (with recursive below as (select thread_id, 1 d from catalog where parent_thread_id = 't5' union all select c.thread_id, b.d + 1 from below b join catalog c on c.parent_thread_id = b.thread_id where b.d < 32) select * from below) group by 1")(lambda x: trees.descendants(x.catalog, "t5"))


@query("own_vs_tree", f"select root_id, max(nodes) nodes, {', '.join(f'cast(coalesce(sum(case when d.thread_id = root_id then {c} end), 0) as bigint) own_{c}, cast(sum({c}) as bigint) tree_{c}' for c in ('event_count', *MEASURES))} from eff_days d join (select *, count(*) over (partition by root_id) nodes from member) m using (thread_id) where quality = 'confirmed' group by 1")
def own_vs_tree(x: Ledger) -> DataFrame:
    nodes = x.members.groupBy("root_id").agg(F.count("*").alias("nodes"))
    rows = x.effective_days.where("quality = 'confirmed'").join(x.members, "thread_id")
    sums = []
    for c in ("event_count", *MEASURES):
        sums += [F.coalesce(F.sum(F.when(F.col("thread_id") == F.col("root_id"), F.col(c))), F.lit(0)).cast("bigint").alias(f"own_{c}"), F.sum(c).cast("bigint").alias(f"tree_{c}")]
    return rows.groupBy("root_id").agg(*sums).join(nodes, "root_id")


@query("subtree_usage", "select a thread_id, cast(coalesce(sum(total), 0) as bigint) subtree_total, cast(coalesce(sum(event_count), 0) as bigint) subtree_events, count(distinct t) nodes from (with recursive up as (select thread_id t, thread_id a, 0 d from catalog union all select u.t, c.parent_thread_id, u.d + 1 from up u join catalog c on c.thread_id = u.a join catalog p on p.thread_id = c.parent_thread_id where u.d < 32) select t, a from up) left join (select * from eff_days where quality = 'confirmed') e on e.thread_id = t group by 1")
def subtree_usage(x: Ledger) -> DataFrame:
    """Of each thread: its own usage and that of all threads below it."""
    own = agg.cube_totals(x.effective_days.where("quality = 'confirmed'"), "thread_id").select("thread_id", "total", "event_count")
    pairs = trees.ancestors(x.catalog).select("thread_id", "ancestor_id")
    return pairs.join(own, "thread_id", "left").groupBy(F.col("ancestor_id").alias("thread_id")).agg(F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("subtree_total"), F.coalesce(F.sum("event_count"), F.lit(0)).cast("bigint").alias("subtree_events"), F.count("*").alias("nodes"))


@query("catalog_counts", "select count(*) filter (present and parent_thread_id is null and depth = 0) current_sessions, count(*) filter (present and (parent_thread_id is not null or depth > 0)) current_subagents, count(*) filter (present and parent_thread_id is null and depth > 0) current_orphans, count(*) filter (not present and parent_thread_id is null and depth = 0) historical_sessions, count(*) filter (not present and (parent_thread_id is not null or depth > 0)) historical_subagents from catalog")
def catalog_counts(x: Ledger) -> DataFrame:
    root, sub, orphan = "parent_thread_id is null and depth = 0", "(parent_thread_id is not null or depth > 0)", "parent_thread_id is null and depth > 0"
    rules = {"current_sessions": f"present and {root}", "current_subagents": f"present and {sub}", "current_orphans": f"present and {orphan}", "historical_sessions": f"not present and {root}", "historical_subagents": f"not present and {sub}"}
    return x.catalog.agg(*[F.count(F.when(F.expr(rule), 1)).alias(name) for name, rule in rules.items()])


@query("catalog_by_project", "select project_id, count(*) filter (present) current_threads, count(*) filter (not present) historical_threads, max(updated_at) updated_at from catalog group by 1")
def catalog_by_project(x: Ledger) -> DataFrame:
    return x.catalog.groupBy("project_id").agg(F.count(F.when(F.col("present"), 1)).alias("current_threads"), F.count(F.when(~F.col("present"), 1)).alias("historical_threads"), F.max("updated_at").alias("updated_at"))


@query("active_sessions", f"select {CLASS}, count(*) threads from catalog f left join standalone s using (thread_id) where present and updated_at >= {T} - interval 5 day group by 1")
def active_sessions(x: Ledger) -> DataFrame:
    rows = x.catalog.where(F.col("present") & (F.col("updated_at") >= source.now() - F.expr("interval 5 days")))
    return agg.classified(rows, x.standalone).groupBy("project").agg(F.count("*").alias("threads"))


@query("standalone_stats", "select (select count(*) from catalog where parent_thread_id is null and depth = 0 and project_id is null and present) as current, (select count(*) from catalog where parent_thread_id is null and depth = 0 and project_id is null and not present) historical, (select count(distinct root_id) from standalone join eff_days using (thread_id) where quality = 'confirmed' and total > 0) with_evidence")
def standalone_stats(x: Ledger) -> DataFrame:
    own = x.catalog.where("parent_thread_id is null and depth = 0 and project_id is null").agg(F.count(F.when(F.col("present"), 1)).alias("current"), F.count(F.when(~F.col("present"), 1)).alias("historical"))
    used = x.effective_days.where("quality = 'confirmed' and total > 0").join(x.standalone, "thread_id").agg(F.countDistinct("root_id").alias("with_evidence"))
    return own.crossJoin(used)  # two single rows


@query("root_member_counts", "select root_id, count(*) nodes from member group by 1")
def root_member_counts(x: Ledger) -> DataFrame:
    return x.members.groupBy("root_id").agg(F.count("*").alias("nodes"))


@query("session_list_topk", "select thread_id, project_id, present, updated_at from catalog where parent_thread_id is null order by present desc, updated_at desc, thread_id desc limit 30")
def session_list_topk(x: Ledger) -> DataFrame:
    return x.catalog.where("parent_thread_id is null").orderBy(F.desc("present"), F.desc("updated_at"), F.desc("thread_id")).limit(30).select("thread_id", "project_id", "present", "updated_at")


# --- changes to the ledger


def _half(x: Ledger, later: bool) -> DataFrame:
    rows = x.facts.where("source_timestamp >= timestamp_ntz'2024-01-10 00:00:00'" if later else "source_timestamp < timestamp_ntz'2024-01-20 00:00:00'")
    return source.catalog(rows)


@query("thread_catalog_merge", "select thread_id, coalesce(n.parent_thread_id, o.parent_thread_id) parent_thread_id, coalesce(n.depth, o.depth) depth, coalesce(n.project_id, o.project_id) project_id, least(n.c, o.c) created_at, greatest(n.u, o.u) updated_at, n.thread_id is not null present from (select thread_id, parent_thread_id, depth, project_id, min(source_timestamp) c, max(source_timestamp) u from facts where source_timestamp < timestamp '2024-01-20' group by all) o full join (select thread_id, parent_thread_id, depth, project_id, min(source_timestamp) c, max(source_timestamp) u from facts where source_timestamp >= timestamp '2024-01-10' group by all) n using (thread_id)")
def thread_catalog_merge(x: Ledger) -> DataFrame:
    return maintenance.merged_catalog(_half(x, False), _half(x, True))


@query("dedup_latest_fact", "select thread_id, event_id, total from (select *, row_number() over (partition by thread_id order by source_timestamp desc, event_id desc) n from facts) where n = 1")
def dedup_latest_fact(x: Ledger) -> DataFrame:
    return maintenance.latest_by_key(x.facts, "thread_id", "source_timestamp", "event_id").select("thread_id", "event_id", "total")


@query("compaction_keys_anti", "select event_id, total from facts where local_day >= '2024-01-15'")
def compaction_keys_anti(x: Ledger) -> DataFrame:
    """Facts delivered again after compaction: those whose keys are kept are left out."""
    _, keys = maintenance.compacted(x.facts, "2024-01-15")
    return maintenance.unseen(x.facts, keys).select("event_id", "total")


@query("compaction_preserves", f"select {CUBE} from days")
def compaction_preserves(x: Ledger) -> DataFrame:
    """Sums of the kept facts and the cube of those that went equal those of all facts."""
    stay, _ = maintenance.compacted(x.facts, "2024-01-15")
    gone = agg.cube(x.facts.where("local_day < '2024-01-15'"), "local_day")
    return agg.cube_totals(agg.cube(stay, "local_day").unionByName(gone))


@query("mutated_replay", "select event_id from facts where event_id % 100 = 0 and total > 0")
def mutated_replay(x: Ledger) -> DataFrame:
    """Keys that are delivered again with another content."""
    again = x.facts.withColumn("total", F.when(F.col("event_id") % 100 == 0, F.col("total") * 2).otherwise(F.col("total")))
    return maintenance.conflicts(again, x.facts, "event_id", "thread_id", "total").select("event_id")


@query("reproject_by_catalog", f"select new_project project_id, {RAW} from (select f.* exclude (project_id), case when c.thread_id is not null then c.p else f.project_id end new_project from facts f left join (select thread_id, case when project_id = 'p1' then 'p9' else project_id end p from catalog where present) c using (thread_id)) group by 1")
def reproject_by_catalog(x: Ledger) -> DataFrame:
    moved = x.catalog.where("present").withColumn("project_id", F.when(F.col("project_id") == "p1", "p9").otherwise(F.col("project_id")))
    return agg.totals(maintenance.reprojected(x.facts, moved), "project_id")


@query("remap_account", f"select case when account = 'acct-c' then 'acct-a' else account end account, {RAW} from facts group by 1")
def remap_account(x: Ledger) -> DataFrame:
    aliases = x.spark.createDataFrame([("acct-c", "acct-a")], "provisional string, canonical string")
    return agg.totals(maintenance.remapped(x.facts, aliases), "account")


# --- attribution

query("account_epochs_inferred", "select * from inferred")(lambda x: x.epochs.drop("confidence"))
query("account_epochs_thinned", "select * from thinned")(lambda x: x.thinned_epochs.drop("confidence"))


@query("account_epoch_lookup", "select event_id, account epoch_account from (select f.event_id, i.account, row_number() over (partition by f.event_id order by i.observed_from desc, i.account desc) n from facts f left join inferred i on f.source_timestamp >= i.observed_from and (i.observed_to is null or f.source_timestamp < i.observed_to)) where n = 1")
def account_epoch_lookup(x: Ledger) -> DataFrame:
    return attribution.epoch_at(x.facts.select("event_id", "source_timestamp"), x.epochs).select("event_id", "epoch_account")


ROOTS = (("/work/p", "p0"), ("/work/p/3", "p3"), ("/work/p/4/x", "p4"), ("/work", "w"))
ROOTS_SQL = "(values " + ", ".join(f"('{p}', '{i}')" for p, i in ROOTS) + ") r(path, project_id)"


def _threads(x: Ledger) -> DataFrame:
    """Threads with a folder: one a project, those of p4 one deeper."""
    return x.catalog.select("thread_id", F.when(F.col("project_id") == "p4", "/work/p/4/x/src").when(F.col("project_id").isNotNull(), F.concat(F.lit("/work/./p/"), F.substring("project_id", 2, 9))).otherwise("/home/z").alias("cwd"))


@query("project_longest_prefix", f"select thread_id, project_id root_project from (select c.thread_id, r.project_id, row_number() over (partition by thread_id order by length(path) desc, path, r.project_id) n from (select thread_id, case when project_id = 'p4' then '/work/p/4/x/src' when project_id is not null then '/work/p/' || substr(project_id, 2) else '/home/z' end cwd from catalog) c join {ROOTS_SQL} on c.cwd = r.path or starts_with(c.cwd, r.path || '/')) where n = 1")
def project_longest_prefix(x: Ledger) -> DataFrame:
    return attribution.longest_root(_threads(x), x.spark.createDataFrame(ROOTS, "path string, project_id string"))


@query("project_priority", f"select c.thread_id, coalesce(case when c.thread_id = 't7' then 'manual' end, case when c.depth = 0 then c.project_id end, r.root_project, p.project_id) project, case when c.thread_id = 't7' then 'manual' when c.depth = 0 and c.project_id is not null then 'native' when r.root_project is not null then 'root' when p.project_id is not null then 'parent' else 'unassigned' end as method from catalog c left join catalog p on p.thread_id = c.parent_thread_id left join (select thread_id, project_id root_project from (select c.thread_id, r.project_id, row_number() over (partition by thread_id order by length(path) desc) n from (select thread_id, case when project_id = 'p4' then '/work/p/4/x/src' when project_id is not null then '/work/p/' || substr(project_id, 2) else '/home/z' end cwd from catalog) c join {ROOTS_SQL} on c.cwd = r.path or starts_with(c.cwd, r.path || '/')) where n = 1) r on r.thread_id = c.thread_id")
def project_priority(x: Ledger) -> DataFrame:
    roots = attribution.longest_root(_threads(x), x.spark.createDataFrame(ROOTS, "path string, project_id string"))
    parents = x.catalog.select(F.col("thread_id").alias("parent_thread_id"), F.col("project_id").alias("parent_project"))
    rows = x.catalog.withColumn("manual_project", F.when(F.col("thread_id") == "t7", "manual")).withColumn("project_id", F.when(F.col("depth") == 0, F.col("project_id"))).withColumn("git_project", F.lit(None).cast("string"))
    return rows.join(roots, "thread_id", "left").join(parents, "parent_thread_id", "left").select("thread_id", *attribution.resolved_project()[:2])


@query("account_registry", "select account, case when account in (select account from official) or account in (select account from inferred) then 'canonical' else 'provisional' end kind from (select distinct account from facts where account is not null)")
def account_registry(x: Ledger) -> DataFrame:
    aliases = x.spark.createDataFrame([], "account string, is_canonical boolean")
    return attribution.registry(x.official, aliases, x.epochs, x.facts)


# --- the external ledger

query("official_day_latest", "select account, day, tokens + case when account = 'acct-a' then 7 else 0 end tokens from official")(
    lambda x: official.latest_days(x.official.withColumn("observed_at", F.lit(1)).unionByName(x.official.where("account = 'acct-a'").withColumn("tokens", F.col("tokens") + 7).withColumn("observed_at", F.lit(2))))
)
query("official_coverage", "select * from coverage")(lambda x: x.coverage)
query("official_common_coverage", "select max(covered_from) covered_from, min(covered_through) covered_through from coverage having count(*) = 2")(lambda x: official.common_coverage(x.coverage, 2))


@query("official_covered_zero_fill", "select coalesce(a.day, g.day) as day, coalesce(tokens, 0) tokens from (select day, cast(sum(tokens) as bigint) tokens from official where account = 'acct-b' and day >= '2024-01-03' and day < '2024-01-18' group by 1) a full join (select distinct day from grid where day between (select max(covered_from) from coverage) and (select min(covered_through) from coverage) and day >= '2024-01-03' and day < '2024-01-18') g on g.day = a.day")
def official_covered_zero_fill(x: Ledger) -> DataFrame:
    return official.zero_filled(x.official.where("account = 'acct-b'"), official.common_coverage(x.coverage, 2), "2024-01-03", "2024-01-18")


query("reconcile_account_days", "select * from reconciled")(lambda x: x.reconciled)
for _grain in ("week", "month"):
    query(
        f"reconcile_by_{_grain}",
        f"select strftime(date_trunc('{_grain}', cast(day as date)), '%Y-%m-%d') bucket, cast(sum(value) as bigint) as value, cast(sum(official_tokens) as bigint) official_tokens, cast(sum(local_tail_tokens) as bigint) local_tail_tokens, cast(sum(local_only_tokens) as bigint) local_only_tokens, max_by(status, case status when 'exact_official' then 1 when 'local_tail' then 2 when 'unknown' then 3 else 4 end) status, min(covered_accounts) covered_accounts, max(known_accounts) known_accounts from reconciled group by 1",
    )(lambda x, g=_grain: official.by_grain(x.reconciled, g))
query(
    "official_display_total",
    "select *, kind <> 'official' is_lower_bound from (select o official_tokens, c complement_tokens, o + c display_tokens, case when n = 0 then 'local_lower_bound' when c > 0 or k <> 4 then 'official_plus_local_tail_lower_bound' else 'official' end kind from (select cast(coalesce(sum(tokens) filter (state = 'official'), 0) as bigint) o, cast(coalesce(sum(tokens) filter (state in ('tail', 'only')), 0) as bigint) c, count(*) filter (state = 'official') n, count(distinct account) filter (state <> 'only') k from account_days))",
)(lambda x: official.display_total(x.account_days, source.DECLARED_ACCOUNTS))


@query("attribution_coverage_gap", "select official, local, named, standalone, unassigned, official - local gap from (select (select cast(sum(value) as bigint) from reconciled) official, cast(sum(total) as bigint) as local, cast(coalesce(sum(total) filter (project not in ('standalone', 'unassigned')), 0) as bigint) named, cast(coalesce(sum(total) filter (project = 'standalone'), 0) as bigint) standalone, cast(coalesce(sum(total) filter (project = 'unassigned'), 0) as bigint) unassigned from (select f.total, case when s.thread_id is not null then 'standalone' when f.project_id = '' then 'unassigned' else f.project_id end project from eff_days f left join standalone s using (thread_id) where quality = 'confirmed'))")
def attribution_coverage_gap(x: Ledger) -> DataFrame:
    rows = agg.classified(x.effective_days.where("quality = 'confirmed'"), x.standalone)
    part = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("total"))), F.lit(0)).cast("bigint").alias(name)
    other = F.col("project").isin(agg.STANDALONE, agg.UNASSIGNED)
    local = rows.agg(F.sum("total").cast("bigint").alias("local"), part(~other, "named"), part(F.col("project") == agg.STANDALONE, "standalone"), part(F.col("project") == agg.UNASSIGNED, "unassigned"))
    whole = x.reconciled.agg(F.sum("value").cast("bigint").alias("official"))
    return whole.crossJoin(local).withColumn("gap", F.col("official") - F.col("local"))  # two single rows


query("residual_rows", "select * from residual_rows")(lambda x: x.residual_rows)
query("residual_allocation", f"select account, day, project, model, event_count, {MS} from allocated")(lambda x: x.allocated)
for _key in ("project", "model", "day", "account"):
    query(f"residual_by_{_key}", f"select {_key}, {CUBE} from allocated group by 1")(lambda x, c=_key: agg.cube_totals(x.allocated, c))
query(
    "residual_alignment",
    "select count(o.tokens) aligned_days, count(*) filter (l > o.tokens) excess_days, count(*) filter (o.tokens is null) excluded_days, cast(coalesce(sum(greatest(l - o.tokens, 0)) filter (o.tokens is not null), 0) as bigint) raw_residual, cast(coalesce(sum(l) filter (o.tokens is not null), 0) as bigint) local_tokens, cast(coalesce(sum(o.tokens), 0) as bigint) official_tokens, cast(coalesce(sum(least(l, o.tokens)) filter (o.tokens is not null), 0) as bigint) capped_tokens from (select account, day, cast(sum(total) as bigint) l from residual_rows group by 1, 2) r left join official o using (account, day)",
)(lambda x: official.alignment(x.residual_rows, x.official, x.official))

# --- views of a period


@query("breakdown_pivot_share", "select *, case when sum(confirmed) over () > 0 then confirmed / cast(sum(confirmed) over () as bigint) else 0 end share from (select nullif(model, '') model, cast(coalesce(sum(total) filter (quality = 'confirmed'), 0) as bigint) confirmed, cast(coalesce(sum(total) filter (quality = 'quarantined'), 0) as bigint) quarantined, cast(coalesce(sum(total) filter (quality = 'unknown'), 0) as bigint) unknown from days group by 1)")
def breakdown_pivot_share(x: Ledger) -> DataFrame:
    return agg.pivot_by_quality(x.days.withColumn("model", agg.dimension("model")), "model")


KPI = f"select cast(coalesce(sum(total) filter (quality = 'confirmed'), 0) as bigint) confirmed, cast(coalesce(sum(total) filter (quality = 'quarantined'), 0) as bigint) quarantined, cast(coalesce(sum(total) filter (quality = 'unknown'), 0) as bigint) unknown, cast(coalesce(sum(input) filter (quality = 'confirmed'), 0) as bigint) i, cast(coalesce(sum(cached_input) filter (quality = 'confirmed'), 0) as bigint) ci, cast(coalesce(sum(event_count) filter (quality = 'confirmed'), 0) as bigint) e, cast(coalesce(sum(event_count) filter (quality = 'unknown'), 0) as bigint) ue from eff_days where local_day between"


@query("summary_kpis", f"select a.confirmed, a.quarantined, a.unknown, b.confirmed previous, case when b.confirmed > 0 then (a.confirmed - b.confirmed) / b.confirmed end delta, case when a.i > 0 then a.ci / a.i else 0 end cache_rate, case when a.e + a.ue > 0 then a.e / (a.e + a.ue) else 1 end match_rate, a.confirmed / greatest(2.3333333333333335::double, 1) average_per_day from ({KPI} '2024-01-29' and '2024-01-31') a cross join ({KPI} '2024-01-22' and '2024-01-24') b")
def summary_kpis(x: Ledger) -> DataFrame:
    """This week's totals by quality, the rates, and the change from the same part of the week before."""
    p = _period("week")
    sum_ = lambda c, q: F.coalesce(F.sum(F.when(F.col("quality") == q, F.col(c))), F.lit(0)).cast("bigint")
    now = agg.cube_range(x.effective_days, _at(p.start), _at(p.end)).agg(
        *[sum_("total", q).alias(q) for q in ("confirmed", "quarantined", "unknown")], sum_("input", "confirmed").alias("i"), sum_("cached_input", "confirmed").alias("ci"), sum_("event_count", "confirmed").alias("e"), sum_("event_count", "unknown").alias("ue")
    )
    before = agg.cube_range(x.effective_days, _at(p.compare_start), _at(p.compare_end)).agg(sum_("total", "confirmed").alias("previous"))
    days = max((p.end - p.start).total_seconds() / 86400, 1.0)
    rows = now.crossJoin(before)  # two single rows
    return rows.select(
        "confirmed", "quarantined", "unknown", "previous", tokens.percent_delta(F.col("confirmed"), F.col("previous")).alias("delta"),
        F.when(F.col("i") > 0, F.col("ci") / F.col("i")).otherwise(F.lit(0.0)).alias("cache_rate"),
        F.when(F.col("e") + F.col("ue") > 0, F.col("e") / (F.col("e") + F.col("ue"))).otherwise(F.lit(1.0)).alias("match_rate"),
        (F.col("confirmed") / F.lit(days)).alias("average_per_day"),
    )


@query("quality_summary", f"select quality, {CUBE}, min(local_day) first_day, max(local_day) last_day from days group by 1")
def quality_summary(x: Ledger) -> DataFrame:
    return x.days.groupBy("quality").agg(*agg.measures(F.col("event_count")), F.min("local_day").alias("first_day"), F.max("local_day").alias("last_day"))


query("account_official_table", "select c.account, c.tokens, c.peak, c.\"days\", c.covered_from, c.covered_through, coalesce(l.tokens, 0) local_tokens from coverage c left join (select account, cast(sum(total) as bigint) tokens from eff_days where quality = 'confirmed' group by 1) l using (account)")(
    lambda x: x.coverage.join(x.local_account_days.groupBy("account").agg(F.sum("tokens").cast("bigint").alias("local_tokens")), "account", "left").na.fill(0, ["local_tokens"])
)


@query("project_ranking", f"select *, case when previous > 0 then (total - previous) / previous when total > 0 then 'Infinity'::double end growth from (select {CLASS}, cast(coalesce(sum(total) filter (local_day between '2024-01-24' and '2024-01-31'), 0) as bigint) total, cast(coalesce(sum(total) filter (local_day between '2024-01-17' and '2024-01-23'), 0) as bigint) previous, count(distinct f.thread_id) threads from eff_days f left join standalone s using (thread_id) where quality = 'confirmed' group by 1)")
def project_ranking(x: Ledger) -> DataFrame:
    rows = agg.classified(x.effective_days.where("quality = 'confirmed'"), x.standalone)
    part = lambda a, b: F.coalesce(F.sum(F.when(F.col("local_day").between(a, b), F.col("total"))), F.lit(0)).cast("bigint")
    out = rows.groupBy("project").agg(part("2024-01-24", "2024-01-31").alias("total"), part("2024-01-17", "2024-01-23").alias("previous"), F.countDistinct("thread_id").alias("threads"))
    growth = F.coalesce(tokens.percent_delta(F.col("total"), F.col("previous")), F.when(F.col("total") > 0, F.lit(float("inf"))))
    return out.withColumn("growth", growth).orderBy(F.desc("total"), "project")


SPARK = f"select {CLASS}, local_day, cast(sum(total) as bigint) total from eff_days f left join standalone s using (thread_id) where quality = 'confirmed' group by 1, 2"


@query("sparkline_last12", f"select project, string_agg(total, ',' order by local_day) points from (select *, row_number() over (partition by project order by local_day desc) n from ({SPARK})) where n <= 12 group by 1")
def sparkline_last12(x: Ledger) -> DataFrame:
    rows = agg.classified(x.effective_days.where("quality = 'confirmed'"), x.standalone).groupBy("project", "local_day").agg(F.sum("total").cast("bigint").alias("total"))
    last = rows.withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("local_day")))).where("n <= 12")
    points = F.transform(F.sort_array(F.collect_list(F.struct("local_day", "total"))), lambda p: p["total"].cast("string"))
    return last.groupBy("project").agg(F.array_join(points, ",").alias("points"))


@query("top7_other", "select case when n <= 7 then thread_id else 'other' end thread_id, cast(sum(total) as bigint) total, count(*) threads from (select *, row_number() over (order by total desc, thread_id) n from (select thread_id, cast(sum(total) as bigint) total from eff_days where quality = 'confirmed' group by 1)) group by 1")
def top7_other(x: Ledger) -> DataFrame:
    """The seven largest threads, and the rest as one: the seven by a top-k, the rest by what isn't among them."""
    rows = x.effective_days.where("quality = 'confirmed'").groupBy("thread_id").agg(F.sum("total").cast("bigint").alias("total"))
    top = rows.orderBy(F.desc("total"), "thread_id").limit(7).withColumn("top", F.lit(True)).select("thread_id", "top")
    return rows.join(top, "thread_id", "left").groupBy(F.when(F.col("top"), F.col("thread_id")).otherwise("other").alias("thread_id")).agg(F.sum("total").cast("bigint").alias("total"), F.count("*").alias("threads"))


query("filter_catalog", "select 'account' dimension, account as value from facts where account is not null union select 'model', model from facts where model is not null union select 'project', project_id from facts where project_id is not null")(
    lambda x: x.facts.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in (("account", "account"), ("model", "model"), ("project", "project_id"))])).alias("v")).select("v.*").where("value is not null").distinct()
)
query("evidence_bounds", "select min(local_day) first_day, max(local_day) last_day, max(source_timestamp) filter (quality = 'confirmed') latest_confirmed from facts")(
    lambda x: x.facts.agg(F.min("local_day").alias("first_day"), F.max("local_day").alias("last_day"), F.max(F.when(F.col("quality") == "confirmed", F.col("source_timestamp"))).alias("latest_confirmed"))
)
query("table_counts", "select (select count(*) from facts) facts, (select count(*) from recon) reconstructed, (select count(*) from catalog) threads")(
    lambda x: x.facts.agg(F.count("*").alias("facts"), F.count(F.when((F.col("quality") == "confirmed") & (F.col("k") % 4 != 3), 1)).alias("reconstructed"), F.countDistinct("thread_id").alias("threads"))
)

# --- ordered operators

DELTA = ", ".join(f"{m} - lag({m}) over w d_{m}" for m in MEASURES)


@query("counter_delta_window", f"select event_id, coalesce(case when least({', '.join('d_' + m for m in MEASURES)}) >= 0 then d_total end, -1) delta, coalesce(least({', '.join('d_' + m for m in MEASURES)}) < 0, false) reset from (select *, {DELTA} from counters window w as (partition by thread_id order by source_timestamp, event_id))")
def counter_delta_window(x: Ledger) -> DataFrame:
    """Difference to a thread's reading before; -1 where there is none or any component falls."""
    order = Window.partitionBy("thread_id").orderBy("source_timestamp", "event_id")
    least = F.least(*[F.col(m) - F.lag(m).over(order) for m in MEASURES])
    rows = x.counters.select("event_id", least.alias("least"), (F.col("total") - F.lag("total").over(order)).alias("d"))
    return rows.select("event_id", F.coalesce(F.when(F.col("least") >= 0, F.col("d")), F.lit(-1)).alias("delta"), F.coalesce(F.col("least") < 0, F.lit(False)).alias("reset"))


@query("context_carry_forward", "select event_id, last_value(case when event_type = 'click' then model end ignore nulls) over (partition by thread_id order by source_timestamp, event_id rows between unbounded preceding and current row) context_model from facts")
def context_carry_forward(x: Ledger) -> DataFrame:
    so_far = Window.partitionBy("thread_id").orderBy("source_timestamp", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.facts.select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("model")), ignorenulls=True).over(so_far).alias("context_model"))


@query("dense_prefix_flags", "select event_id, sum(gap) over (partition by thread_id order by source_timestamp, event_id) = 0 prefix from (select *, case when source_timestamp - lag(source_timestamp) over (partition by thread_id order by source_timestamp, event_id) > interval 6 hour then 1 else 0 end gap from facts)")
def dense_prefix_flags(x: Ledger) -> DataFrame:
    """Whether a thread's events up to here follow each other within six hours."""
    order = Window.partitionBy("thread_id").orderBy("source_timestamp", "event_id")
    gap = F.coalesce((F.col("source_timestamp") - F.lag("source_timestamp").over(order) > F.expr("interval 6 hours")).cast("int"), F.lit(0))
    return x.facts.select("event_id", "thread_id", "source_timestamp", gap.alias("gap")).select("event_id", (F.sum("gap").over(order) == 0).alias("prefix"))


@query("cumulative_reconstruct", f"select thread_id, {', '.join(f'cast(sum(case when f is null then {m} when least({chr(44).join("d_" + x for x in MEASURES)}) >= 0 then d_{m} else 0 end) as bigint) {m}' for m in MEASURES)} from (select *, lag(event_id) over w f, {DELTA} from counters window w as (partition by thread_id order by source_timestamp, event_id)) group by 1")
def cumulative_reconstruct(x: Ledger) -> DataFrame:
    """Usage of each thread from its counters: the first reading in full, then differences, nothing at a reset."""
    order = Window.partitionBy("thread_id").orderBy("source_timestamp", "event_id")
    delta = [(F.col(m) - F.lag(m).over(order)).alias(f"d_{m}") for m in MEASURES]
    rows = x.counters.select("*", F.lag("event_id").over(order).alias("f"), *delta)
    rises = F.least(*[f"d_{m}" for m in MEASURES]) >= 0
    return rows.groupBy("thread_id").agg(*[F.sum(F.when(F.col("f").isNull(), F.col(m)).when(rises, F.col(f"d_{m}")).otherwise(F.lit(0))).cast("bigint").alias(m) for m in MEASURES])


# --- quota

query("quota_latest_pool", "select account, event_id, used_percent, resets_at, case when used_percent >= 90 then 'critical' when used_percent >= 72 then 'warning' else 'normal' end status, least(greatest(100 - used_percent, 0), 100) remaining from (select *, row_number() over (partition by account order by observed_at desc, event_id desc) n from quota) where n = 1")(
    lambda x: quota.latest(x.quota).select("account", "event_id", "used_percent", "resets_at", tokens.status(F.col("used_percent")).alias("status"), tokens.remaining_percent(F.col("used_percent")).alias("remaining"))
)


@query("quota_cycle_current", "select account, first_at, last_at, samples, used_delta, cycle_start, (select coalesce(cast(sum(total) as bigint), 0) from hours h where h.quality = 'confirmed' and h.account = c.account and h.local_hour >= strftime(local_start + interval 8 hour, '%Y-%m-%dT%H:00')) tokens from (select *, last_used - first_used used_delta, greatest(cycle_start, first_at) local_start from (select account, min(observed_at) first_at, max(observed_at) last_at, count(*) samples, arg_min(used_percent, observed_at) first_used, arg_max(used_percent, observed_at) last_used, max(resets_at) - interval 5 day cycle_start from (select *, max(other) over (partition by account order by observed_at, event_id rows between current row and unbounded following) later from (select *, case when resets_at = last_value(resets_at) over (partition by account order by observed_at, event_id rows between unbounded preceding and unbounded following) then 0 else 1 end other from quota)) where later = 0 group by 1)) c")
def quota_cycle_current(x: Ledger) -> DataFrame:
    return quota.cycle_usage(quota.current_cycle(x.quota), x.hours).select("account", "first_at", "last_at", "samples", "used_delta", "cycle_start", "tokens")


@query("quota_account_switches", "select event_id, before, account from (select event_id, account, lag(account) over (order by observed_at, event_id) before from markers where kind = 'account_seen') where before is not null and account is distinct from before")
def quota_account_switches(x: Ledger) -> DataFrame:
    seen = source.auth_markers(x.facts).where("kind = 'account_seen'").withColumn("source_id", F.lit("log"))
    return quota.switches(seen).select("event_id", "before", "account")


query("quota_reset_events", "select * from resets")(lambda x: quota.reset_events(x.quota))

# --- state machines, tested against step-by-step versions


def _observations(x: Ledger, kind: str) -> DataFrame:
    return x.facts.where(F.col("event_type") == kind).select("thread_id", F.col("event_id").alias("id"), F.col("source_timestamp").alias("at"))


#: The greedy rule for DuckDB, an observation of each thread a step; a step takes along what its thread has used.
GREEDY = """with recursive observed as (select thread_id, event_id id, epoch_us(source_timestamp) t, row_number() over (partition by thread_id order by source_timestamp, event_id) n from facts where event_type = 'click'),
seen as (select thread_id, event_id id, epoch_us(source_timestamp) t from facts where event_type = 'view'),
greedy as (select thread_id, 0::bigint n, []::bigint[] used, null::bigint observation_id, null::bigint candidate_id, null::bigint gap_micros from (select distinct thread_id from observed)
union all
select w.thread_id, o.n, case when b.id is null then w.used else list_append(w.used, b.id) end, o.id, b.id, b.gap from greedy w join observed o on o.thread_id = w.thread_id and o.n = w.n + 1
left join lateral (select v.id, abs(v.t - o.t) gap from seen v where v.thread_id = o.thread_id and abs(v.t - o.t) <= 21600000000 and not list_contains(w.used, v.id) order by abs(v.t - o.t), v.t, v.id limit 1) b on true)
select thread_id, observation_id, candidate_id, gap_micros from greedy where n > 0"""


query("interval_match_greedy")(lambda x: machines.matched(_observations(x, "click"), _observations(x, "view"), 6 * 3600 * 1_000_000))
query("interval_match_pairs", f"select * from ({GREEDY}) where candidate_id is not null")(
    lambda x: machines.matched(_observations(x, "click"), _observations(x, "view"), 6 * 3600 * 1_000_000).where("candidate_id is not null")
)
query("interval_match_unmatched", f"select thread_id, observation_id from ({GREEDY}) where candidate_id is null")(
    lambda x: machines.matched(_observations(x, "click"), _observations(x, "view"), 6 * 3600 * 1_000_000).where("candidate_id is null").select("thread_id", "observation_id")
)


@query("interval_match_nearest", "select id, candidate_id, gap_micros from (select o.event_id id, c.event_id candidate_id, cast(abs(epoch_us(c.source_timestamp) - epoch_us(o.source_timestamp)) as bigint) gap_micros, row_number() over (partition by o.event_id order by abs(epoch_us(c.source_timestamp) - epoch_us(o.source_timestamp)), c.source_timestamp, c.event_id) n from facts o join facts c on c.thread_id = o.thread_id and c.event_type = 'view' and abs(epoch_us(c.source_timestamp) - epoch_us(o.source_timestamp)) <= 21600000000 where o.event_type = 'click') where n = 1")
def interval_match_nearest(x: Ledger) -> DataFrame:
    """Each observation's nearest candidate within six hours, which others may share.

    The last candidate before and the first after, by windows over the union of both: no join of a thread with itself.
    """
    tag = lambda kind, o: _observations(x, kind).withColumn("own", F.lit(o))
    rows = tag("click", True).unionByName(tag("view", False))
    candidate = F.when(~F.col("own"), F.struct("at", "id"))
    past = Window.partitionBy("thread_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    future = Window.partitionBy("thread_id").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    latest = F.max(F.when(~F.col("own"), F.col("at"))).over(past)
    rows = rows.withColumn("before_at", latest).withColumn("after", F.min(candidate).over(future))
    first_of = rows.where("not own").groupBy("thread_id", F.col("at").alias("before_at")).agg(F.min("id").alias("before_id"))
    micros = lambda c: F.expr(f"unix_micros(cast({c} as timestamp))")
    own = rows.where("own").join(first_of, ["thread_id", "before_at"], "left")
    options = F.array_compact(F.array(*[F.when(i.isNotNull() & (F.abs(g) <= 21_600_000_000), F.struct(F.abs(g).alias("gap"), a.alias("at"), i.alias("id"))) for g, a, i in ((micros("at") - micros("before_at"), F.col("before_at"), F.col("before_id")), (micros("after.at") - micros("at"), F.col("after.at"), F.col("after.id")))]))
    best = F.array_min(options)
    return own.select(F.col("id"), best.alias("best")).where("best is not null").select("id", F.col("best.id").alias("candidate_id"), F.col("best.gap").alias("gap_micros"))


def _records(x: Ledger) -> DataFrame:
    """Counters as records of a session log, one file a thread, each beginning with its session's record."""
    usage = [F.col(m).alias(f"total_{m}") for m in MEASURES]
    readings = x.counters.join(x.facts.select("event_id", *[F.col(m).alias(f"last_{m}") for m in MEASURES]), "event_id")
    rows = readings.select(F.col("thread_id").alias("source"), F.col("event_id").alias("line_no"), F.lit("token_count").alias("kind"), F.col("source_timestamp").cast("timestamp").alias("at"), *usage, *[f"last_{m}" for m in MEASURES])
    metas = x.catalog.select(F.col("thread_id").alias("source"), F.lit(-1).cast("bigint").alias("line_no"), F.lit("session_meta").alias("kind"), F.col("created_at").cast("timestamp").alias("at"), F.col("thread_id").alias("session_id"), F.col("parent_thread_id").alias("parent_id"))
    out = metas.unionByName(rows, allowMissingColumns=True)
    for c, kind in (("model", "string"), ("cwd", "string"), ("turn_id", "string"), ("started_at", "bigint")):
        out = out.withColumn(c, F.lit(None).cast(kind))
    return out


def _plain_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


query("replay_guard_facts", "select * from guard")(lambda x: _plain_time(machines.guarded(_records(x))))
query("reconstruction_machine", "select * from remade")(lambda x: _plain_time(machines.reconstructed(_records(x), x.catalog.select(F.col("thread_id").alias("source"), "thread_id", "parent_thread_id"))))


def _in_slices(x: Ledger, machine: ingest.Machine, slices: int = 3) -> DataFrame:
    """The facts of files that arrive in slices: each goes on from the state that the one before has left."""
    rows, out, state = settle(_records(x)), [], None
    cuts = [r[0] for r in rows.agg(F.percentile_approx("line_no", [i / slices for i in range(1, slices)])).collect()][0] or []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        own = rows.where((F.lit(lo is None) | (F.col("line_no") > F.lit(lo))) & (F.lit(hi is None) | (F.col("line_no") <= F.lit(hi))))
        walked = machine.walk(own, state)
        out.append(machine.facts(walked))
        new = machine.state(walked)
        state = settle(new if state is None else new.unionByName(state.join(new.select("source"), "source", "left_anti")))
    return _plain_time(reduce(DataFrame.unionByName, out))


query("replay_guard_slices", "select * from guard")(lambda x: _in_slices(x, ingest.GUARD))
query("reconstruction_slices", "select * from remade")(lambda x: _in_slices(x, ingest.rebuilding(x.catalog.select(F.col("thread_id").alias("source"), "thread_id", "parent_thread_id"))))

# --- scalar functions over small inputs

REMOTES = ("git@Host.example:Owner/Repo.git", "https://user:pw@host.example/owner/repo.git?x=1#f", "ssh://git@host.example/owner/repo/", "", "host.example/owner/repo")


@query("git_identity_normalize", f"select raw, case when raw <> '' then 'host.example/owner/repo' end identity from (values {', '.join(f'({chr(39)}{r}{chr(39)})' for r in REMOTES)}) r(raw)")
def git_identity_normalize(x: Ledger) -> DataFrame:
    return x.spark.createDataFrame([(r,) for r in REMOTES], "raw string").select("raw", text.git_identity("raw").alias("identity"))


@query("uuid7_millis", "select event_id, epoch_us(source_timestamp) // 1000 millis from facts")
def uuid7_millis(x: Ledger) -> DataFrame:
    digits = F.lpad(F.lower(F.hex(F.expr("unix_millis(cast(source_timestamp as timestamp))"))), 12, "0")
    uuid = F.concat(F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 9, 4), F.lit("-7000-8000-000000000000"))
    return x.facts.select("event_id", time.uuid7_millis(uuid).alias("millis"))


@query("label_redaction", "select thread_id, case when depth > 0 then case when u % 3 = 0 then 'step ' || u else 'Subagent ' || thread_id end when u % 4 = 0 then 'Session ' || thread_id else 'plan ' || u end as label from (select thread_id, depth, cast(substr(thread_id, 2) as bigint) u from catalog)")
def label_redaction(x: Ledger) -> DataFrame:
    u = F.substring("thread_id", 2, 20).cast("bigint")
    title = F.when(u % 4 == 0, F.concat(F.lit("mail a"), u, F.lit("@example.com"))).otherwise(F.concat(F.lit("plan "), u))
    path = F.when(u % 3 == 0, F.concat(F.lit("/a/step_"), u, F.lit("/")))
    return x.catalog.select("thread_id", text.thread_label(F.col("depth"), path, F.lit(None).cast("string"), title, F.col("thread_id")).alias("label"))


@query("quota_payload_flatten", "select event_id, w as window_name, case when w = 'primary' and k between 0 and 100 then cast(k as double) when w = 'secondary' and k * 2 between 0 and 100 then cast(k * 2 as double) end used_percent, case when w = 'primary' then 18000 else 604800 end window_seconds from (select event_id, k, unnest(['primary', 'secondary']) w from facts where event_type = 'signup')")
def quota_payload_flatten(x: Ledger) -> DataFrame:
    """Windows of quota payloads, whatever their names: percentages outside 0 to 100 are null, minutes become seconds."""
    payload = F.to_json(F.struct(F.struct(F.col("k").alias("used_percent"), F.lit(300).alias("window_minutes")).alias("primary"), F.struct((F.col("k") * 2).alias("used_percent"), F.lit(604800).alias("limit_window_seconds")).alias("secondary")))
    window = "map<string, struct<used_percent: double, window_minutes: bigint, limit_window_seconds: bigint>>"
    rows = x.facts.where("event_type = 'signup'").select("event_id", F.explode(F.from_json(payload, window)).alias("window_name", "w"))
    return rows.select("event_id", "window_name", F.when(F.col("w.used_percent").between(0, 100), F.col("w.used_percent")).alias("used_percent"), F.coalesce("w.limit_window_seconds", F.col("w.window_minutes") * 60).cast("int").alias("window_seconds"))
