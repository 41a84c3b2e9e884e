"""Further registered queries: scans, maintenance of dimensions, health, exports, windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload
from ..operators import aggregates as agg
from ..operators import attribution, maintenance, quota
from ..operators.slots import neighbour
from ..sources import discovery
from ..sources import ledger as source
from . import views
from .catalogue import _period, query
from .ledger import Ledger
from .oracle import CUBE, RAW, T

FILES = "(select 's' || u source, 'i' || (u // 2) identity, count(*) * 100 length, u from (select user_id u from facts) group by u)"


@query("pending_files", f"select source, identity, length, coalesce(c.at, s.at, 0) as \"offset\" from (select * from {FILES}) f left join (select 's' || u source, case when u % 3 = 0 then n * 100 else n * 100 // 2 end as at from (select user_id u, count(*) n from facts group by 1) where u % 3 < 2) c using (source) left join (select 'i' || (u // 2) identity, max(case when u % 3 = 0 then n * 100 else n * 100 // 2 end) as at from (select user_id u, count(*) n from facts group by 1) where u % 3 < 2 group by 1) s using (identity) where coalesce(c.at, s.at, 0) <> length")
def pending_files(x: Ledger) -> DataFrame:
    u = F.col("user_id")
    files = x.facts.groupBy("user_id").agg((F.count("*") * 100).alias("length")).select(F.concat(F.lit("s"), u).alias("source"), F.concat(F.lit("i"), F.floor(u / 2)).alias("identity"), "length", "user_id")
    cursors = files.where("user_id % 3 < 2").select("source", "identity", F.expr("case when user_id % 3 = 0 then length else length div 2 end").alias("offset"))
    return discovery.pending(files.drop("user_id"), cursors)


def _logs(x: Ledger) -> DataFrame:
    return x.facts.select(F.col("event_id").alias("id"), F.col("source_timestamp").alias("at"), F.col("event_type").alias("target"), "thread_id", F.concat(F.lit("k="), "k", F.lit(" account "), F.coalesce("account", F.lit("-"))).alias("body"))


@query("log_scan", f"select event_id id, thread_id from facts where event_id > 100 and source_timestamp <= {T} - interval 5 second and event_type = 'click' and ('k=' || k || ' account ' || coalesce(account, '-')) like '%k=1%'")
def log_scan(x: Ledger) -> DataFrame:
    return discovery.log_rows(_logs(x), 100, source.now(), "click", "k=1").select("id", "thread_id").orderBy("id")


@query("log_high_water", f"select coalesce(max(event_id), 0) id from facts where source_timestamp <= {T} - interval 5 second")
def log_high_water(x: Ledger) -> DataFrame:
    return discovery.high_water(_logs(x), source.now())


@query("log_auth_markers", "select event_id id, case when event_type = 'error' then 'account_seen' else 'login' end kind, coalesce(account, '-') account from facts where event_type = 'error' or event_type = 'signup' and k < 5")
def log_auth_markers(x: Ledger) -> DataFrame:
    body = F.when((F.col("target") != "signup") | F.regexp_extract("body", r"k=(\d+)", 1).cast("int").between(0, 4), F.concat(F.lit("go "), "body"))
    rules = {"account_seen": ("error", "account "), "login": ("signup", "go ")}
    return discovery.auth_markers(_logs(x).withColumn("body", body), rules, "account ").select("id", "kind", "account")


@query("quota_tail_threads", "select thread_id, updated_at from catalog c where depth = 0 and parent_thread_id is null and updated_at >= (select max(updated_at) from catalog) - interval 12 hour and not exists (select 1 from catalog e where e.parent_thread_id = c.thread_id and e.depth = 1 and right(e.thread_id, 1) = '1') order by updated_at desc, thread_id limit 512")
def quota_tail_threads(x: Ledger) -> DataFrame:
    last = x.catalog.agg(F.max("updated_at").alias("t")).first()
    now = F.lit(last.t if last else None).cast("timestamp_ntz")
    edges = x.catalog.where("depth = 1 and right(thread_id, 1) = '1' and parent_thread_id is not null").select(F.col("parent_thread_id").alias("child"))
    return discovery.recent_roots(x.catalog, edges, now).select("thread_id", "updated_at")


@query("reconstruction_targets", "select thread_id, min('/logs/' || event_id) path from facts where event_id % 10 <> 0 group by 1")
def reconstruction_targets(x: Ledger) -> DataFrame:
    return discovery.first_per_id(x.facts.select("thread_id", F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("/logs/"), "event_id")).alias("path")))


@query("account_list", "select account from official union select account from facts where account is not null")
def account_list(x: Ledger) -> DataFrame:
    return discovery.account_list(x.official, x.facts)


@query("indexed_files", "select distinct '/work/p/' || coalesce(project_id, 'x') || '/r.jsonl' path from catalog where project_id is not null")
def indexed_files(x: Ledger) -> DataFrame:
    index = x.catalog.select(F.concat(F.when(F.col("project_id").isNotNull(), F.lit("/work/./p/")).otherwise(F.lit("/workshop/p/")), F.coalesce("project_id", F.lit("x")), F.lit("/r.jsonl")).alias("path"))
    return discovery.indexed_files(index, ["/work/"])


# --- sessions


@query("session_nodes", "select thread_id, relative_depth, parent_thread_id, updated_at, coalesce(o.total, 0) own_total, (select cast(coalesce(sum(e.total), 0) as bigint) from up join eff_days e on e.thread_id = up.t and e.quality = 'confirmed' where up.a = n.thread_id) subtree_total from (select m.thread_id, m.relative_depth, c.parent_thread_id, c.updated_at from member m join catalog c using (thread_id) where m.root_id = 't5') n left join (select thread_id, cast(sum(total) as bigint) total from eff_days where quality = 'confirmed' group by 1) o using (thread_id)".replace("from up join", "from (with recursive up as (select thread_id t, thread_id a, 0 d from catalog union all select u.t, c.parent_thread_id, u.d + 1 from up u join catalog c on c.thread_id = u.a where c.parent_thread_id is not null and u.d < 32) select t, a from up) up join"))
def session_nodes(x: Ledger) -> DataFrame:
    return views.session_nodes(x, "t5")


@query("tree_search", "select a thread_id, min(d) = 0 hit from (with recursive up as (select thread_id t, thread_id a, 0 d from catalog where contains(lower(thread_id), '3') union all select u.t, c.parent_thread_id, u.d + 1 from up u join catalog c on c.thread_id = u.a join catalog p on p.thread_id = c.parent_thread_id where u.d < 32) select * from up) group by 1")
def tree_search(x: Ledger) -> DataFrame:
    return views.search(x, "3")


query(
    "timeline",
    f"select observed_at as at, 'account_switch' kind, account, concat_ws(' > ', before, account) detail from (select event_id, observed_at, account, lag(account) over (order by observed_at, event_id) before from markers where kind = 'account_seen') where before is not null and account is distinct from before union all select resets.at, 'quota_reset', account, reset_class from resets union all select resets_at, 'quota_reset_scheduled', account, 'scheduled' from (select *, row_number() over (partition by account order by observed_at desc, event_id desc) n from quota) where n = 1 and resets_at > {T}",
)(views.timeline)
query("bundle")(views.bundle)


@query("auth_epochs_appended", "select account, observed_from, observed_to from (select account, observed_at observed_from, lead(observed_at) over (order by observed_at, event_id) observed_to from (select *, lag(account) over (order by observed_at, event_id) b, row_number() over (order by observed_at, event_id) n from markers where kind = 'account_seen' and account is not null) where n = 1 or account <> b)")
def auth_epochs_appended(x: Ledger) -> DataFrame:
    """Intervals from sightings: an equal account changes nothing, another closes the open interval."""
    seen = source.auth_markers(x.facts).where("kind = 'account_seen' and account is not null").withColumn("source_id", F.lit("log"))
    order, keys = ["observed_at", "event_id"], ("source_id",)
    changes = neighbour(seen, ["account"], order, keys).where("near is null or near.account <> account").drop("near")
    return neighbour(changes, ["observed_at"], order, keys, after=True).select("account", F.col("observed_at").alias("observed_from"), F.col("near.observed_at").alias("observed_to"))


@query("alias_latest", "select thread_id workspace, coalesce(max(account) filter (event_type = 'click'), max_by(account, event_id) filter (account is not null)) account from facts where account is not null group by 1")
def alias_latest(x: Ledger) -> DataFrame:
    """The account of a workspace: a canonical one wins and is never replaced by a provisional one."""
    rows = x.facts.where("account is not null").select(F.col("thread_id").alias("workspace"), "account", (F.col("event_type") == "click").alias("canonical"), "event_id")
    return rows.groupBy("workspace").agg(F.coalesce(F.max(F.when(F.col("canonical"), F.col("account"))), F.max_by("account", "event_id")).alias("account"))


@query("newest_quota_readings", "select account, event_id, used_percent from (select *, row_number() over (partition by account order by observed_at desc, event_id desc) n from quota) where n <= 20")
def newest_quota_readings(x: Ledger) -> DataFrame:
    """The newest 20 readings of each account. The reference's list, of 1,000, is quota_readings_listed."""
    return quota.newest(x.quota, 20).select("account", "event_id", "used_percent")


@query("quota_readings_listed", "select account, event_id, used_percent from (select *, row_number() over (partition by account order by observed_at desc, event_id desc) n from quota) where n <= 1000")
def quota_readings_listed(x: Ledger) -> DataFrame:
    """The newest readings of each account, as many as the reference lists."""
    return quota.newest(x.quota).select("account", "event_id", "used_percent")


@query("quota_changes_only", "select event_id, used_percent from (select *, lag(used_percent) over (partition by account order by observed_at, event_id) b from quota) where used_percent is distinct from b")
def quota_changes_only(x: Ledger) -> DataFrame:
    return maintenance.without_repeats(x.quota, "account", "used_percent", "observed_at", "event_id").select("event_id", "used_percent")


# --- cubes kept up to date


@query("cube_increment", f"select local_day, thread_id, account, project_id, model, quality, event_count, input, cached_input, cache_write_input, cache_write_observed, output, reasoning_output, total from days where event_count > 0")
def cube_increment(x: Ledger) -> DataFrame:
    """The day cube from that of older facts, the delta of new ones and of ones taken back."""
    older, newer = x.facts.where("event_id % 3 <> 0"), x.facts.where("event_id % 3 = 0")
    twice = x.facts.where("event_id % 5 = 0")
    minus = agg.cube(twice, "local_day")
    minus = minus.select(*[(-F.col(c)).alias(c) if c in ("event_count", *agg.MEASURES) else F.col(c) for c in minus.columns])
    parts = agg.cube(older.unionByName(twice), "local_day").unionByName(agg.cube(newer, "local_day")).unionByName(minus)
    return agg.cube_totals(parts, "local_day", *agg.DIMENSIONS, "quality").where("event_count > 0")


@query("tumbling_local_days", f"select cast(cast(local_day as date) as timestamp) - interval 8 hour window_start, {RAW} from facts group by 1")
def tumbling_local_days(x: Ledger) -> DataFrame:
    """Local days as tumbling windows that start at 16:00 UTC."""
    return agg.totals(x.facts, F.window("source_timestamp", "1 day", startTime="16 hours")["start"].alias("window_start"))


@query("recent_activity", f"select count(*) filter (source_timestamp > t - interval 15 minute) last15, count(*) filter (source_timestamp > t - interval 5 minute) last5 from facts cross join (select max(source_timestamp) t from facts)")
def recent_activity(x: Ledger) -> DataFrame:
    last = x.facts.agg(F.max("source_timestamp").alias("t")).first()
    now, at = F.lit(last.t if last else None).cast("timestamp_ntz"), F.col("source_timestamp")
    return x.facts.where(at > now - F.expr("interval 15 minutes")).agg(F.count("*").alias("last15"), F.count(F.when(at > now - F.expr("interval 5 minutes"), 1)).alias("last5"))


@query("retention", f"select local_day, {CUBE} from days where local_day < strftime({T} - interval 7 day + interval 8 hour, '%Y-%m-%d') group by 1")
def retention(x: Ledger) -> DataFrame:
    """What is left of days past retention: their sums in the cube."""
    return agg.cube_totals(x.days.where(F.col("local_day") < "2024-01-24"), "local_day")


# --- health


@query("source_health", "select event_type as machine, max(source_timestamp) latest, count(*) sources from facts group by 1")
def source_health(x: Ledger) -> DataFrame:
    return x.facts.groupBy(F.col("event_type").alias("machine")).agg(F.max("source_timestamp").alias("latest"), F.count("*").alias("sources"))


@query("epoch_stats", "select account, count(*) epochs, min(observed_from) first_from, max(observed_to) last_to from inferred group by 1")
def epoch_stats(x: Ledger) -> DataFrame:
    return x.epochs.groupBy("account").agg(F.count("*").alias("epochs"), F.min("observed_from").alias("first_from"), F.max("observed_to").alias("last_to"))


@query("freshness_marker", "select concat_ws('|', cast(max(event_id) as varchar), cast(count(*) as varchar), max(local_hour), cast((select count(*) from catalog) as varchar), (select max(day) from official)) marker from facts")
def freshness_marker(x: Ledger) -> DataFrame:
    """A text that changes when any relation does."""
    facts = x.facts.agg(F.max("event_id").alias("a"), F.count("*").alias("b"), F.max("local_hour").alias("c"), F.countDistinct("thread_id").alias("d"))
    return facts.crossJoin(x.official.agg(F.max("day").alias("e"))).select(F.concat_ws("|", *[F.col(c).cast("string") for c in "abcde"]).alias("marker"))  # two single rows


@query("registry_counts", "select 4 as declared, count(*) filter (kind = 'canonical') confirmed, count(*) filter (kind = 'provisional') provisional, greatest(4 - count(*) filter (kind = 'canonical'), 0) unobserved from (select account, case when account in (select account from official) or account in (select account from inferred) then 'canonical' else 'provisional' end kind from (select distinct account from facts where account is not null))")
def registry_counts(x: Ledger) -> DataFrame:
    rows = registry_rows(x)
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return rows.agg(F.lit(source.DECLARED_ACCOUNTS).alias("declared"), n("canonical").alias("confirmed"), n("provisional").alias("provisional"), F.greatest(F.lit(source.DECLARED_ACCOUNTS) - n("canonical"), F.lit(0)).alias("unobserved"))


def registry_rows(x: Ledger) -> DataFrame:
    aliases = x.spark.createDataFrame([], "account string, is_canonical boolean")
    return attribution.registry(x.official, aliases, x.epochs, x.facts)


@query("quality_states", "select quality, cast(sum(event_count) as bigint) event_count, sum(event_count) / (select sum(event_count) from days) share, case when quality = 'confirmed' then 'ok' when sum(event_count) * 10 > (select sum(event_count) from days) then 'warning' else 'notice' end state from days group by 1")
def quality_states(x: Ledger) -> DataFrame:
    rows = x.days.groupBy("quality").agg(F.sum("event_count").cast("bigint").alias("event_count"))
    whole = F.sum("event_count").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("share", F.col("event_count") / whole).withColumn("state", F.when(F.col("quality") == "confirmed", "ok").when(F.col("event_count") * 10 > whole, "warning").otherwise("notice"))


@query("export_points", "select o.day, o.tokens official, l.tokens as local from (select day, cast(sum(tokens) as bigint) tokens from official group by 1) o left join (select local_day as day, cast(sum(total) as bigint) tokens from eff_days where quality = 'confirmed' group by 1) l using (day)")
def export_points(x: Ledger) -> DataFrame:
    """Official points with local ones of the same day, where there are any."""
    local = x.effective_days.where("quality = 'confirmed'").groupBy(F.col("local_day").alias("day")).agg(F.sum("total").cast("bigint").alias("local"))
    return x.official.groupBy("day").agg(F.sum("tokens").cast("bigint").alias("official")).join(local, "day", "left")


@query("periods", "select * from (values ('today', '2024-01-30 16:00:00', 'hour'), ('week', '2024-01-28 16:00:00', 'day'), ('rolling7', '2024-01-24 00:00:00', 'day'), ('month', '2023-12-31 16:00:00', 'day'), ('rolling30', '2024-01-01 00:00:00', 'day'), ('weeks12', '2023-11-12 16:00:00', 'week'), ('months12', '2023-01-31 16:00:00', 'month'), ('lifetime', null, 'month')) p(label, starts_at, grain)")
def periods(x: Ledger) -> DataFrame:
    labels = ("today", "week", "rolling7", "month", "rolling30", "weeks12", "months12", "lifetime")
    rows = [(p.label, p.start.strftime("%Y-%m-%d %H:%M:%S") if p.start else None, p.grain) for p in map(_period, labels)]
    return x.spark.createDataFrame(rows, "label string, starts_at string, grain string")


@query("quota_payload_pools", "select event_id, 'main' pool_key, 'primary' window_name, case when k <= 90 then k + 10.0::double end used_percent, cast(18000 as bigint) window_seconds from facts where event_type = 'signup' union all select event_id, 'extra', 'secondary', cast(k as double), cast(604800 as bigint) from facts where event_type = 'signup'")
def quota_payload_pools(x: Ledger) -> DataFrame:
    window = lambda used, **more: F.struct(used.alias("used_percent"), *[F.lit(v).alias(k) for k, v in more.items()])
    main = F.struct(window(F.col("k") + 10, window_minutes=300).alias("primary"), F.lit(True).alias("allowed"))
    extra = F.struct(F.lit("extra").alias("limit_name"), F.struct(window(F.col("k"), limit_window_seconds=604800).alias("secondary")).alias("rate_limit"))
    rows = x.facts.where("event_type = 'signup'").select("event_id", F.to_json(F.struct(main.alias("rate_limit"), F.array(extra).alias("additional_rate_limits"))).alias("payload"))
    return payload.quota_windows(rows).select("event_id", "pool_key", "window_name", "used_percent", "window_seconds")


_INNER, _OUTER = (bytes(b ^ pad for b in b"local key".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
_FRAMED = f"{7:016x}" + b"account".hex()


query("account_fingerprints", f"select account, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}{_FRAMED}') || unhex(lpad(hex(octet_length(encode(account))), 16, '0')) || encode(account)))) fingerprint from (select distinct account from facts where account is not null)")(
    lambda x: x.accounts.select("account", payload.fingerprint(F.col("account"), b"local key", "account").alias("fingerprint"))
)
query("latest_quota_by_epoch_account", "select account, max(observed_at) latest from quota group by 1")(lambda x: quota.latest(x.quota).select("account", F.col("observed_at").alias("latest")))
