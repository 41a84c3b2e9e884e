"""Registered queries that put sections together: the dashboard, a snapshot, issues, orders and revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payload, text, time, tokens
from ..functions.tokens import MEASURES
from ..operators import aggregates as agg
from ..operators import maintenance, official, sections, trees
from ..operators.order import numbered
from ..sources import discovery, index
from ..sources import ledger as source
from . import accounts, more, views
from .accounts import DISPLAY
from .catalogue import CLASS, HEAD, ORACLES, TAIL, THREAD_LIST, THREADS, breakdown_pivot_share, catalog_counts, effective_by_project, literal, quality_summary, query, standalone_stats, summary_kpis
from .ledger import Ledger
from .oracle import CUBE, RAW

MS = ", ".join(MEASURES)


# --- one pass for many sections

SETS = {
    "total": "quality", "points": "local_day, quality", "project_series": "project, local_day, quality",
    "by_project": "project, quality", "by_model": "model, quality", "by_account": "account, quality",
}


def _sets_sql(cube: str, windows: dict[str, tuple[str, str]]) -> str:
    spread = " union all ".join(f"select '{name}' part, * from ({cube}) where local_day between '{a}' and '{b}'" for name, (a, b) in windows.items())
    return " union all by name ".join(f"select '{name}' section, part, {keys}, {CUBE} from ({spread}) group by part, {keys}" for name, keys in SETS.items())


_MONTH = {"current": ("2024-01-01", "2024-01-31")}
_WEEK = {"current": ("2024-01-29", "2024-01-31"), "comparison": ("2024-01-22", "2024-01-24")}
_PROJECTS = f"select f.* exclude (project_id), {CLASS} from {{}} f left join standalone s using (thread_id)"
_COLUMNS = f"section, part, quality, local_day, project, model, account, event_count, {MS}"


def _classified(x: Ledger, cube: DataFrame) -> DataFrame:
    return agg.classified(cube, x.standalone)


@query("dashboard", f"select {_COLUMNS} from ({_sets_sql(_PROJECTS.format('eff_days'), _WEEK)})")
def dashboard(x: Ledger) -> DataFrame:
    """Totals, points, project series and breakdowns of this week by quality, and of the same part of the week before."""
    return sections.sections(_classified(x, x.effective_days), _WEEK)


@query("snapshot", f"select {_COLUMNS} from ({_sets_sql(_PROJECTS.format('days'), _MONTH)})")
def snapshot(x: Ledger) -> DataFrame:
    """The same sections of the sampled cube for this month: quality, series, models, accounts and projects."""
    return sections.sections(_classified(x, x.days), _MONTH)


# --- issues

STATUS = "(select count(*) filter (u % 4 <= 1) pending, count(*) filter (u % 4 = 3) unrecoverable from (select distinct user_id u from facts))"
PROVISIONAL = "(select count(*) provisional, cast(coalesce(sum(t), 0) as bigint) provisional_tokens from (select distinct account from facts where account is not null and account not in (select account from official) and account not in (select account from inferred)) left join (select account, sum(total) t from eff_days where quality = 'confirmed' group by 1) using (account))"
BY_QUALITY = "(select cast(coalesce(sum(event_count) filter (quality = 'quarantined'), 0) as bigint) quarantined, cast(coalesce(sum(total) filter (quality = 'quarantined'), 0) as bigint) quarantined_tokens, cast(coalesce(sum(event_count) filter (quality = 'unknown'), 0) as bigint) unknown from eff_days where local_day between '2024-01-01' and '2024-01-31')"


@query(
    "issues",
    "select i.id, i.state, i.severity, i.n, i.event_count, coalesce(i.token_count, -1) token_count, '2024-01-01' first_seen, '2024-01-31' last_seen from (select unnest(["
    "{'id': 'quarantined-events', 'state': 'quarantined', 'severity': 'critical', 'n': quarantined, 'event_count': quarantined, 'token_count': quarantined_tokens}, "
    "{'id': 'unknown-events', 'state': 'unknown', 'severity': 'warning', 'n': unknown, 'event_count': unknown, 'token_count': null}, "
    "{'id': 'official-account-calibration', 'state': 'unknown', 'severity': 'warning', 'n': 4 - k, 'event_count': 0, 'token_count': null}, "
    "{'id': 'provisional-account-identities', 'state': 'unknown', 'severity': 'warning', 'n': provisional, 'event_count': 0, 'token_count': provisional_tokens}, "
    "{'id': 'rollout-reconstruction-pending', 'state': 'unknown', 'severity': 'info', 'n': pending, 'event_count': 0, 'token_count': null}, "
    "{'id': 'rollout-reconstruction-unrecoverable', 'state': 'unknown', 'severity': 'warning', 'n': unrecoverable, 'event_count': 0, 'token_count': null}]) i"
    f" from {BY_QUALITY} cross join {DISPLAY} cross join {PROVISIONAL} cross join {STATUS}) where i.n > 0",
)
def issues(x: Ledger) -> DataFrame:
    """What is wrong this month: one row an issue, by rules over the cube, the accounts and the reconstruction; -1 tokens: not known."""
    of = lambda q, c: F.coalesce(F.sum(F.when(F.col("quality") == q, F.col(c))), F.lit(0))
    cube = x.effective_days.where(F.col("local_day").between(*_MONTH["current"])).agg(of("quarantined", "event_count").alias("quarantined"), of("quarantined", "total").alias("quarantined_tokens"), of("unknown", "event_count").alias("unknown"))
    official_ = official.resolved_total(x.account_days, source.DECLARED_ACCOUNTS).select("missing_accounts")
    local = x.local_account_days.groupBy("account").agg(F.sum("tokens").alias("t"))
    provisional = more.registry_rows(x).where("kind = 'provisional'").join(local, "account", "left").agg(F.count("*").alias("provisional"), F.coalesce(F.sum("t"), F.lit(0)).alias("provisional_tokens"))
    files = discovery.reconstruction_status(accounts.reconstruction_files(x), x.selection).select((F.col("pending") + F.col("reconstructing")).alias("pending"), "unrecoverable")
    state = cube.crossJoin(official_).crossJoin(provisional).crossJoin(files)  # single rows
    return sections.issues(state, F.lit(_MONTH["current"][0]), F.lit(_MONTH["current"][1])).na.fill(-1, ["token_count"])


# --- orders

FOREST = "with recursive ranked as (select c.*, row_number() over (partition by parent_thread_id order by updated_at desc, thread_id) r from catalog c), walk as (select thread_id, thread_id root_id, 0 relative_depth, [0::bigint] path from ranked where parent_thread_id is null union all select c.thread_id, w.root_id, w.relative_depth + 1, list_append(w.path, c.r) from walk w join ranked c on c.parent_thread_id = w.thread_id where w.relative_depth < 32) select * from walk"


@query("session_nodes_hierarchy", f"select thread_id, root_id, relative_depth, (select count(*) from ({FOREST}) b where b.root_id = a.root_id and b.path[1:len(a.path)] = a.path) subtree_size, row_number() over (partition by root_id order by path) - 1 as position from ({FOREST}) a")
def session_nodes_hierarchy(x: Ledger) -> DataFrame:
    """All threads of all sessions, each followed by what is below it, siblings by their last activity."""
    return trees.preorder(x.catalog, x.members)


RANKED = f"select *, case when previous > 0 then (total - previous) / previous when total > 0 then 'Infinity'::double else 0 end growth from (select {CLASS}, cast(coalesce(sum(total) filter (local_day between '2024-01-24' and '2024-01-31'), 0) as bigint) total, cast(coalesce(sum(total) filter (local_day between '2024-01-17' and '2024-01-23'), 0) as bigint) previous, count(distinct f.thread_id) threads from eff_days f left join standalone s using (thread_id) where quality = 'confirmed' group by 1) left join (select {CLASS}, max(source_timestamp) last_at, cast(coalesce(sum(total) filter (source_timestamp >= timestamp '2024-01-30 23:45:00'), 0) as bigint) recent from facts f left join standalone s using (thread_id) where quality = 'confirmed' group by 1) using (project)"


@query("project_orders", f"select project, total, previous, threads, last_at, coalesce(recent, 0) recent, row_number() over (order by total desc, project) - 1 by_tokens, row_number() over (order by growth desc, project) - 1 by_growth, row_number() over (order by last_at desc nulls last, project) - 1 by_recent, row_number() over (order by coalesce(recent, 0) desc, project) - 1 by_rate, row_number() over (order by threads desc, project) - 1 by_sessions from ({RANKED})")
def project_orders(x: Ledger) -> DataFrame:
    """Each project's place in all five orders: tokens, growth, last activity, the last quarter of an hour, sessions."""
    part = lambda a, b: F.coalesce(F.sum(F.when(F.col("local_day").between(a, b), F.col("total"))), F.lit(0)).cast("bigint")
    rows = _classified(x, x.effective_days.where("quality = 'confirmed'")).groupBy("project").agg(part("2024-01-24", "2024-01-31").alias("total"), part("2024-01-17", "2024-01-23").alias("previous"), F.countDistinct("thread_id").alias("threads"))
    facts = agg.classified(x.facts.where("quality = 'confirmed'").withColumn("project_id", F.coalesce("project_id", F.lit(""))), x.standalone)
    recent = F.coalesce(F.sum(F.when(F.col("source_timestamp") >= literal("2024-01-30 23:45:00"), F.col("total"))), F.lit(0)).cast("bigint")
    seen = facts.groupBy("project").agg(F.max("source_timestamp").alias("last_at"), recent.alias("recent"))
    growth = F.coalesce(tokens.percent_delta(F.col("total"), F.col("previous")), F.when(F.col("total") > 0, F.lit(float("inf"))), F.lit(0.0))
    out = rows.join(seen, "project", "left").na.fill(0, ["recent"]).withColumn("growth", growth)
    for name, by in (("by_tokens", "total"), ("by_growth", "growth"), ("by_recent", "last_at"), ("by_rate", "recent"), ("by_sessions", "threads")):
        out = numbered(out, F.desc_nulls_last(by), F.col("project"), name=name)
    return out.drop("growth")


# --- the external ledger

SEEN = "select account, day, tokens, day::timestamp + interval 36 hour observed_at from official union all select account, day, tokens + 100, day::timestamp + interval 60 hour from official where day(cast(day as date)) % 4 = 0"
ASOF = "(select account, day, arg_max(tokens, observed_at) tokens from ({}) where observed_at <= timestamp '{}' group by 1, 2)"
EARLIER, LATER = "2024-01-12 00:00:00", "2024-01-20 00:00:00"


def _seen(x: Ledger) -> DataFrame:
    """Snapshots of the ledger's days: each a day and a half after it began, some once more with another sum."""
    at = lambda hours: F.col("day").cast("timestamp_ntz") + F.expr(f"interval {hours} hours")
    again = x.official.where(F.dayofmonth(F.to_date("day")) % 4 == 0).select("account", "day", F.col("tokens") + 100, at(60))
    return x.official.select("account", "day", "tokens", at(36).alias("observed_at")).union(again)


@query("official_revisions", f"select account, day, b.tokens as before, a.tokens as after, a.tokens - coalesce(b.tokens, 0) delta from {ASOF.format(SEEN, LATER)} a left join {ASOF.format(SEEN, EARLIER)} b using (account, day) where a.tokens is distinct from b.tokens")
def official_revisions(x: Ledger) -> DataFrame:
    """What the ledger says of its days at one time and at a later one, where that differs."""
    return official.revised(_seen(x), literal(EARLIER), literal(LATER))


query("official_as_of", f"select account, day, tokens from {ASOF.format(SEEN, EARLIER)}")(lambda x: official.as_of(_seen(x), literal(EARLIER)))


@query("official_period_delta", "select total, previous, total - previous delta, case when previous > 0 then (total - previous) / previous end delta_percent from (select cast(sum(tokens) filter (day between '2024-01-16' and '2024-01-30') as bigint) total, cast(sum(tokens) filter (day between '2024-01-01' and '2024-01-15') as bigint) previous from official)")
def official_period_delta(x: Ledger) -> DataFrame:
    return official.period_delta(x.official, ("2024-01-16", "2024-01-30"), ("2024-01-01", "2024-01-15"))


# --- averages

query("series_average_peak", "select cast(avg(total) as double) average, max(total) peak, arg_max(local_day, (total, local_day)) peak_day, count(*) points from (select local_day, cast(sum(total) as bigint) total from eff_days where quality = 'confirmed' group by 1)")(
    lambda x: agg.cube_totals(x.effective_days.where("quality = 'confirmed'"), "local_day").agg(F.avg("total").alias("average"), F.max("total").alias("peak"), F.max_by("local_day", F.struct("total", "local_day")).alias("peak_day"), F.count("*").alias("points"))
)


# --- scalar functions over facts

LAG = "epoch(timestamp '2024-01-31 00:00:00' - source_timestamp)"


@query("labels_and_states", f"""select event_id, case when k * 7200 between 518400 and 691200 then 'weekly' when k * 7200 <= 86400 then 'short' else 'custom' end window_kind,
    least(greatest(100 - k * 1.5, 0), 100)::double remaining, case when {LAG} <= 900 then 'fresh' else 'stale' end official_state, {LAG} > 600 quota_stale,
    date_trunc('hour', source_timestamp) floor_hour, case when date_trunc('hour', source_timestamp) = source_timestamp then source_timestamp else date_trunc('hour', source_timestamp) + interval 1 hour end ceil_hour,
    case when length(account || '-' || thread_id) > 8 then substr(account || '-' || thread_id, 1, 8) || '…' else account || '-' || thread_id end account_label, substr(sha256(thread_id), 1, 8) thread_hash,
    coalesce(model, case when k % 3 = 0 then 'main' end, 'additional') quota_label, greatest(input - total, 0) missing, least(total::hugeint * 9223372036854775, 9223372036854775807)::bigint at_most
    from facts""")
def labels_and_states(x: Ledger) -> DataFrame:
    """Labels, hashes, staleness and rounding of each fact's columns."""
    lag = F.unix_micros(literal("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("source_timestamp").cast("timestamp"))
    name, k = F.concat_ws("-", "account", "thread_id"), F.col("k").cast("bigint")
    return x.facts.select(
        "event_id", tokens.window_kind(k * 7200).alias("window_kind"), tokens.remaining_percent(k * 1.5).alias("remaining"), tokens.official_freshness(lag / 1e6).alias("official_state"), tokens.quota_stale(lag / 1e6).alias("quota_stale"),
        time.floor_hour("source_timestamp").alias("floor_hour"), time.ceil_hour("source_timestamp").alias("ceil_hour"),
        F.when(F.col("account").isNotNull(), text.account_label(name)).alias("account_label"), text.short_hash("thread_id").alias("thread_hash"),
        payload.quota_label(F.col("model"), F.when(k % 3 == 0, "main"), F.lit("additional-1")).alias("quota_label"),
        tokens.saturating_sub(F.col("input"), F.col("total")).alias("missing"), tokens.saturating(F.col("total").cast("decimal(20,0)") * F.lit(9223372036854775).cast("decimal(18,0)")).alias("at_most"),
    )


# --- trees by what threads are called, assignments, windows by dimension

CALLED = "(select thread_id, parent_thread_id, 'Task ' || substr(thread_id, 2) title, 'n' || (cast(substr(thread_id, 2) as bigint) % 13) nickname, max(model) model from facts group by 1, 2)"


def _called(x: Ledger) -> DataFrame:
    number = F.substring("thread_id", 2, 20)
    return x.facts.groupBy("thread_id", "parent_thread_id").agg(F.max("model").alias("model")).withColumns({"title": F.concat(F.lit("Task "), number), "nickname": F.concat(F.lit("n"), (number.cast("bigint") % 13).cast("string"))})


@query("tree_search_fields", f"select a thread_id, min(d) = 0 hit from (with recursive up as (select thread_id t, thread_id a, 0 d from {CALLED} where contains(lower(concat_ws(' ', title, nickname, model)), '2 n1') union all select u.t, c.parent_thread_id, u.d + 1 from up u join catalog c on c.thread_id = u.a join catalog p on p.thread_id = c.parent_thread_id where u.d < 32) select * from up) group by 1")
def tree_search_fields(x: Ledger) -> DataFrame:
    """Threads whose title, nickname or model contain a text, with all above them."""
    return views.search_fields(_called(x), " 2 N1", "title", "nickname", "model")


query("tree_focus", "select thread_id, depth from catalog where thread_id in (with recursive below as (select 't5' t, 0 d union all select c.thread_id, b.d + 1 from below b join catalog c on c.parent_thread_id = b.t where b.d < 32) select t from below)")(lambda x: views.focus(x.catalog, "t5").select("thread_id", "depth"))


@query("manual_assignments", "select thread_id, project_id, assigned_at from (select thread_id, case when k % 3 > 0 then 'hand' || (k % 3) end project_id, source_timestamp assigned_at, row_number() over (partition by thread_id order by source_timestamp desc, event_id desc) n from facts where event_type = 'purchase' and k < 20) where n = 1 and project_id is not null")
def manual_assignments(x: Ledger) -> DataFrame:
    changes = x.facts.where("event_type = 'purchase' and k < 20").select("thread_id", F.when(F.col("k") % 3 > 0, F.concat(F.lit("hand"), F.col("k") % 3)).alias("project_id"), F.col("source_timestamp").alias("assigned_at"), "event_id")
    return maintenance.assigned(changes)


for _key in ("project_id", "model", "account"):
    query(f"rolling7_by_{_key.removesuffix('_id')}", f"select coalesce({_key}, '') {_key}, {RAW} from eff_facts where quality = 'confirmed' and source_timestamp >= timestamp '{HEAD}' and source_timestamp < timestamp '{TAIL}' group by 1")(
        lambda x, c=_key: agg.totals(agg.in_range(x.effective_facts.where("quality = 'confirmed'"), literal(HEAD), literal(TAIL)), F.coalesce(c, F.lit("")).alias(c))
    )
query("cube_of_threads", f"select {CUBE} from days where thread_id in ({THREAD_LIST})")(lambda x: agg.cube_totals(x.days.where(F.col("thread_id").isin(*THREADS))))
query("raw_of_threads", f"select {RAW} from facts where thread_id in ({THREAD_LIST})")(lambda x: agg.totals(x.facts.where(F.col("thread_id").isin(*THREADS))))
query("raw_of_threads_by_thread", f"select thread_id, {RAW} from facts where thread_id in ({THREAD_LIST}) group by 1")(lambda x: agg.totals(x.facts.where(F.col("thread_id").isin(*THREADS)), "thread_id"))


# --- the thread index

INDEXED = "select thread_id, '/w/' || case when user_id % 7 <> 0 then 'p' || (user_id % 7) || '/' else '' end || 'x' cwd, case when user_id % 7 <> 0 then 'p' || (user_id % 7) end project_id, parent_thread_id, max(model) model from facts group by 1, 2, 3, 4"


@query("thread_index", f"select thread_id, parent_thread_id, cwd, model, project_id project, case when project_id is null then 'unassigned' when n % 2 = 0 then 'native' else 'root' end as method from (select *, cast(substr(thread_id, 2) as bigint) n from ({INDEXED}))")
def thread_index(x: Ledger) -> DataFrame:
    """An index in two snapshots: one has projects and parents as columns, the other knows neither, only folders and JSON."""
    number = F.col("user_id") % 7
    project = F.when(number != 0, F.concat(F.lit("p"), number))
    rows = x.facts.withColumn("cwd", F.concat(F.lit("/w/"), F.coalesce(F.concat(project, F.lit("/")), F.lit("")), F.lit("x")))
    rows = rows.groupBy("thread_id", "cwd", project.alias("project_id"), "parent_thread_id", "user_id").agg(F.max("model").alias("model"))
    spawned = F.to_json(F.struct(F.struct(F.struct("parent_thread_id").alias("thread_spawn")).alias("subagent")))
    full = rows.where("user_id % 2 = 0").select(F.col("thread_id").alias("id"), "cwd", "model", "project_id", "parent_thread_id", F.lit("cli").alias("source"))
    bare = rows.where("user_id % 2 = 1").select(F.col("thread_id").alias("id"), "cwd", "model", spawned.alias("source"))
    roots = x.spark.createDataFrame([(f"/w/p{i}", f"p{i}") for i in range(1, 7)], "path string, project_id string")
    return index.resolved(index.united(full, bare), roots).select("thread_id", "parent_thread_id", "cwd", "model", "project", "method")


# --- the whole catalog of an index

#: Of each thread number u: folders under the roots of four of six projects, remotes, own projects, sub-agents; every third thread is in a snapshot without the optional columns.
_THREADS = "(select user_id u, thread_id, parent_thread_id, depth d, max(model) model, min(source_timestamp) c, max(source_timestamp) m, user_id % 7 r, user_id % 3 <> 0 f from facts group by all)"
_SEEN = f"""(select *, case when u % 2 = 0 or u % 3 = 0 then 'host.example/own/r' || r end git, case when r between 1 and 4 then 'p' || r end root,
  case when f and u % 11 = 0 and r > 0 then 'p' || r end native, case when u % 13 = 0 then case when u % 2 = 0 then 'hand' else 'p1' end end manual, parent_thread_id is not null spawned from {_THREADS})"""
_LEARNED = f"(select git identity, min(project) git_project from (select git, root project from {_SEEN} where root is not null union all select git, native from {_SEEN} where u % 2 = 0) where git is not null and project is not null group by 1)"


@query("native_catalog", f"""select thread_id, parent_thread_id, coalesce(manual, native, root, git_project) project,
    case when manual = 'hand' then 'By hand' when coalesce(manual, native, root, git_project) is not null then 'Project ' || substr(coalesce(manual, native, root, git_project), 2) end project_name,
    case when manual is not null then 'manual' when native is not null then 'native' when root is not null then 'root' when git_project is not null then 'git' else 'unassigned' end as method,
    case when f and u % 5 = 1 then 'Name ' || u when u % 4 > 0 then 'Title ' || u end title, model,
    case when spawned and u % 2 = 0 then 'n' || (u % 13) when f then 'col' || r end agent_nickname,
    cast(case when spawned and u % 4 > 0 then d when spawned or f and d > 0 then 1 else 0 end as bigint) depth,
    case when f and u % 2 = 0 then date_trunc('milliseconds', c) else date_trunc('second', c) end created_at, date_trunc('second', m) updated_at, u % 6 = 0 archived, u % 6 <> 1 has_user_event
    from {_SEEN} left join {_LEARNED} on identity = git""")
def native_catalog(x: Ledger) -> DataFrame:
    """The catalog of two snapshots, projects with roots, remotes learned from threads, and assignments by hand."""
    u, r = F.col("u"), F.col("u") % 7
    named = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    rows = x.facts.groupBy(F.col("user_id").alias("u"), "thread_id", "parent_thread_id", "depth").agg(F.max("model").alias("model"), F.min("source_timestamp").alias("c"), F.max("source_timestamp").alias("m"))
    millis = lambda c: F.expr(f"timestampdiff(millisecond, timestamp_ntz'1970-01-01', {c})")
    spawn = F.struct("parent_thread_id", F.when(u % 4 > 0, F.col("depth")).alias("depth"), F.when(u % 2 == 0, named("n", u % 13)).alias("agent_nickname"))
    remote = F.when(u % 2 == 0, F.concat(F.lit("git@Host.example:own/r"), r, F.lit(".git"))).when(u % 3 == 0, named("https://host.example/own/r", r))
    rows = rows.select(
        "u", F.col("thread_id").alias("id"), F.when(r.between(1, 4), F.concat(named("/w/p", r), F.lit("/x"))).otherwise(named("/tmp/", u)).alias("cwd"), remote.alias("git_origin"), "model",
        F.when(u % 4 > 0, named("Title ", u)).otherwise(" ").alias("title"), F.floor(millis("c") / 1000).alias("created_at"), F.floor(millis("m") / 1000).alias("updated_at"), (u % 6 == 0).alias("archived"), (u % 6 != 1).alias("has_user_event"),
        F.when(F.col("parent_thread_id").isNotNull(), F.to_json(F.struct(F.struct(spawn.alias("thread_spawn")).alias("subagent")))).otherwise("cli").alias("source"),
        F.when(u % 5 == 1, named("Name ", u)).otherwise("  ").alias("name"), named("col", r).alias("agent_nickname"), F.when(F.col("depth") > 0, "subagent").alias("thread_source"),
        F.when((u % 11 == 0) & (r > 0), F.concat(F.when(u % 2 == 0, "").otherwise(" "), named("p", r))).alias("project_id"), F.when(u % 2 == 0, millis("c")).alias("created_at_ms"),
    )
    full = rows.where("u % 3 <> 0").drop("u")
    bare = rows.where("u % 3 = 0").drop("u", "name", "agent_nickname", "thread_source", "project_id", "created_at_ms")
    projects = x.spark.createDataFrame([(f"p{i}", f"Project {i}") for i in range(1, 7)], "project_id string, project_name string")
    roots = x.spark.createDataFrame([(f"/w/p{i}", f"p{i}") for i in range(1, 5)], "path string, project_id string")
    by_hand = F.when(u % 2 == 0, "hand").otherwise("p1")
    manual = rows.where("u % 13 = 0").select(F.col("id").alias("thread_id"), by_hand.alias("manual_project"), F.when(u % 2 == 0, "By hand").alias("manual_name"))
    return index.catalog(index.united(full, bare), projects, roots, manual).drop("confidence", "agent_role", "agent_path")


# --- the explorer's figures, and all sections in one table

_DAYS = {"today": ("2024-01-31", "2024-01-31"), "week": ("2024-01-29", "2024-01-31"), "lifetime": ("0000-01-01", "9999-12-31")}
_RECENT = "timestamp '2024-01-30 23:45:00'"
_FIGURES = ", ".join(
    f"cast(coalesce(sum({c}) filter (local_day between '{a}' and '{b}'{rule}), 0) as bigint) {of}{name}_{c}"
    for name, (a, b) in _DAYS.items() for of, rule, cs in (("", "", ("total", "event_count")), ("standalone_", " and project = 'standalone'", ("total",))) for c in cs
)


@query(
    "explorer_stats",
    f"select * from (select {_FIGURES} from ({_PROJECTS.format('eff_days')} where quality = 'confirmed')) cross join (select cast(coalesce(sum(total), 0) as bigint) recent_total, count(distinct thread_id) active_sessions from facts where quality = 'confirmed' and source_timestamp >= {_RECENT})"
    f" cross join ({ORACLES['catalog_counts']}) cross join (select \"current\" standalone_current, historical standalone_historical, with_evidence standalone_with_evidence from ({ORACLES['standalone_stats']})) cross join (select count(distinct project_id) projects from catalog)",
)
def explorer_stats(x: Ledger) -> DataFrame:
    """One row: usage of today, this week and ever, alone and of standalone threads, the last quarter of an hour, counts."""
    day = lambda name: F.col("local_day").between(*_DAYS[name])
    summed = lambda c, rule: F.coalesce(F.sum(F.when(rule, F.col(c))), F.lit(0)).cast("bigint")
    alone = F.col("project") == "standalone"
    usage = _classified(x, x.effective_days.where("quality = 'confirmed'")).agg(
        *[summed(c, day(n)).alias(f"{n}_{c}") for n in _DAYS for c in ("total", "event_count")], *[summed("total", day(n) & alone).alias(f"standalone_{n}_total") for n in _DAYS]
    )
    recent = x.facts.where((F.col("quality") == "confirmed") & (F.col("source_timestamp") >= literal("2024-01-30 23:45:00"))).agg(F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("recent_total"), F.countDistinct("thread_id").alias("active_sessions"))
    own = standalone_stats(x).select(*[F.col(c).alias(f"standalone_{c}") for c in ("current", "historical", "with_evidence")])
    projects = x.catalog.agg(F.countDistinct("project_id").alias("projects"))
    return usage.crossJoin(recent).crossJoin(catalog_counts(x)).crossJoin(own).crossJoin(projects)  # single rows


#: Sections of a whole bundle: what names a row, and its figures.
_BUNDLE = {
    "summary_kpis": ((), ("confirmed", "quarantined", "unknown", "previous", "delta", "cache_rate", "match_rate", "average_per_day")),
    "dashboard": (("section", "part", "quality", "local_day", "project", "model", "account"), ("event_count", *MEASURES)),
    "effective_by_project": (("project",), ("event_count", *MEASURES, "share")),
    "breakdown_pivot_share": (("model",), ("confirmed", "quarantined", "unknown", "share")),
    "project_orders": (("project",), ("total", "previous", "threads", "recent", "by_tokens", "by_growth", "by_recent", "by_rate", "by_sessions")),
    "quality_summary": (("quality", "first_day", "last_day"), ("event_count", *MEASURES)),
    "issues": (("id", "state", "severity"), ("n", "event_count", "token_count")),
    "explorer_stats": ((), ("today_total", "week_total", "lifetime_total", "standalone_lifetime_total", "recent_total", "active_sessions", "current_sessions", "historical_sessions", "projects")),
    "reconstruction_status": ((), ("pending", "reconstructing", "reconstructed", "unrecoverable", "bytes_processed", "bytes_total", "selected_tokens")),
}


def _bundle_sql() -> str:
    parts = []
    for name, (keys, figures) in _BUNDLE.items():
        key = f"concat_ws('|', {', '.join(f"coalesce({k}, '')" for k in keys)})" if keys else "''"
        parts.append(f"select '{name}' part, {key} item, unnest([{', '.join(f"'{c}'" for c in figures)}]) figure, unnest([{', '.join(f'{c}::double' for c in figures)}]) as value from ({ORACLES[name]})")
    return " union all ".join(f"(select * from ({p}) where value is not null)" for p in parts)


@query("bundle_values", _bundle_sql())
def bundle_values(x: Ledger) -> DataFrame:
    """(part, item, figure, value): every section of a dashboard as one table of figures; what isn't known has no row."""
    x.settle_cubes()
    plans = {
        "summary_kpis": summary_kpis, "dashboard": dashboard, "effective_by_project": effective_by_project, "breakdown_pivot_share": breakdown_pivot_share, "project_orders": project_orders,
        "quality_summary": quality_summary, "issues": issues, "explorer_stats": explorer_stats, "reconstruction_status": accounts.reconstruction_status,
    }
    return sections.figures({name: (plan(x), *_BUNDLE[name]) for name, plan in plans.items()})
