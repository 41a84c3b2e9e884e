"""The ledger's relations in DuckDB SQL, for checks of the queries by an engine of its own."""

from __future__ import annotations

import re

from ..functions.tokens import MEASURES
from ..sources.ledger import NOW

M = ", ".join(f"coalesce(cast(sum({m}) as bigint), 0) {m}" for m in MEASURES)
RAW = f"count(*) event_count, {M}"
CUBE = f"coalesce(cast(sum(event_count) as bigint), 0) event_count, {M}"
KEYS = "coalesce(thread_id, '') thread_id, coalesce(account, '') account, coalesce(project_id, '') project_id, coalesce(model, '') model"
T = f"timestamp '{NOW}'"



def _each(text: str, between: str = ", ") -> str:
    """A piece of SQL for each measure, whose name stands for @."""
    return between.join(text.replace("@", m) for m in MEASURES)


def _valid(prefix: str) -> str:
    return f"({prefix}cached_input + {prefix}cache_write_input <= {prefix}input and {prefix}cache_write_observed <= {prefix}input and {prefix}input + {prefix}output = {prefix}total and {prefix}reasoning_output <= {prefix}output)"


#: Whether a reading s is a reset after the high water of w.
HIT = "(s.used_percent < w.high and w.high - s.used_percent >= 5 and s.resets_at is distinct from w.high_reset and s.confirmed)"

RELATIONS = {
    "raw_events": """
  select event_id, ts source_timestamp, user_id u, cast(json_extract_string(props, '$.k') as int) k, event_type,
         cast(round(value * 100) as bigint) c from events""",
    "facts": """
  select event_id, source_timestamp, 't' || u thread_id,
         case when u % 37 = 36 or u % 5 = 0 then null when u % 5 <= 2 then 't' || (u - u % 5) else 't' || (u - 1) end parent_thread_id,
         cast(case when u % 37 = 36 then 1 when u % 5 = 0 then 0 when u % 5 <= 2 then 1 else u % 5 - 1 end as int) depth,
         case when u % 7 <> 0 then 'p' || (u % 7) end project_id,
         case u % 4 when 0 then 'acct-a' when 1 then 'acct-b' when 2 then 'acct-c' end account,
         case when k % 10 <> 9 then 'm' || (k % 3) end model,
         case event_type when 'error' then 'quarantined' when 'signup' then 'unknown' else 'confirmed' end quality,
         c - c // 5 as input, (c - c // 5) // 2 cached_input,
         case when k % 2 = 0 then (c - c // 5) // 10 else 0 end cache_write_input,
         case when k % 2 = 0 then c - c // 5 else 0 end cache_write_observed,
         c // 5 as output, c // 5 // 3 reasoning_output, c total, k, event_type, u user_id,
         strftime(source_timestamp + interval 8 hour, '%Y-%m-%d') local_day,
         strftime(source_timestamp + interval 8 hour, '%Y-%m-%dT%H:00') local_hour
  from raw_events""",
    "recon": """
  select * replace (input + k as input, total + k as total, case when cache_write_observed > 0 then input + k else 0 end as cache_write_observed)
  from facts where quality = 'confirmed' and k % 4 <> 3""",
    "days": f"select local_day, {KEYS}, quality, {RAW} from facts group by all",
    "hours": f"select local_hour, {KEYS}, quality, {RAW} from facts group by all",
    "recon_days": f"select local_day, {KEYS}, {RAW} from recon group by all",
    "recon_hours": f"select local_hour, {KEYS}, {RAW} from recon group by all",
    "catalog": f"""
  select thread_id, parent_thread_id, depth, project_id, min(source_timestamp) created_at, max(source_timestamp) updated_at,
         max(source_timestamp) >= {T} - interval 20 day present from facts group by all""",
    "member": """
  select thread_id, min(root_id) root_id, min(relative_depth) relative_depth from tree group by 1""",
    "tree": """
  select thread_id, thread_id root_id, 0 relative_depth from catalog where parent_thread_id is null
  union all
  select c.thread_id, t.root_id, t.relative_depth + 1 from tree t join catalog c on c.parent_thread_id = t.thread_id where t.relative_depth < 32""",
    "standalone": """
  select m.thread_id, m.root_id from member m join catalog c on c.thread_id = m.root_id where c.depth = 0 and c.project_id is null""",
    "selection": """
  select local_day, thread_id, coalesce(s, 0) sampling_tokens, coalesce(r, 0) reconstruction_tokens,
         case when coalesce(r, 0) > coalesce(s, 0) then 'reconstruction' else 'sampling' end source
  from (select local_day, thread_id, cast(sum(total) as bigint) s from days where quality = 'confirmed' group by all)
  full join (select local_day, thread_id, cast(sum(total) as bigint) r from recon_days group by all) using (local_day, thread_id)""",
    "eff_days": """
  select d.* from days d join selection s using (local_day, thread_id) where s.source = 'sampling'
  union all by name
  select d.*, 'confirmed' quality from recon_days d join selection s using (local_day, thread_id) where s.source = 'reconstruction'""",
    "eff_hours": """
  select d.* from hours d join selection s on s.local_day = substr(d.local_hour, 1, 10) and s.thread_id = d.thread_id where s.source = 'sampling'
  union all by name
  select d.*, 'confirmed' quality from recon_hours d join selection s on s.local_day = substr(d.local_hour, 1, 10) and s.thread_id = d.thread_id where s.source = 'reconstruction'""",
    "eff_facts": """
  select f.*, 'sampling' source from facts f join selection s using (local_day, thread_id) where s.source = 'sampling'
  union all by name
  select f.*, 'reconstruction' source from recon f join selection s using (local_day, thread_id) where s.source = 'reconstruction'""",
    "official": """
  select account, local_day as day, cast(sum(case when day(cast(local_day as date)) % 3 <> 0 or event_type in ('click', 'purchase') then total else 0 end)
         + case when day(cast(local_day as date)) % 3 = 2 then 5000 else 0 end as bigint) tokens
  from facts where quality = 'confirmed'
   and (account = 'acct-a' and local_day <= '2024-01-25' or account = 'acct-b' and local_day between '2024-01-05' and '2024-01-20')
  group by account, local_day""",
    "coverage": "select account, min(day) covered_from, max(day) covered_through, count(*) \"days\", cast(sum(tokens) as bigint) tokens, max(tokens) peak from official group by 1",
    "grid": """
  select account, strftime(d, '%Y-%m-%d') as day from (select distinct account from facts where account is not null)
  cross join (select unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) d)""",
    "account_days": """
  select account, day, state, coalesce(case when state = 'official' then o else l end, 0) tokens from (
    select g.account, g.day, o.tokens o, l.tokens l,
           case when c.covered_from is null then 'only' when g.day between c.covered_from and c.covered_through then 'official'
                when g.day > c.covered_through then 'tail' else 'gap' end state
    from grid g left join coverage c using (account) left join official o using (account, day)
    left join (select account, local_day as day, cast(sum(total) as bigint) tokens from eff_days where quality = 'confirmed' group by 1, 2) l using (account, day))""",
    "reconciled": """
  select day, cast(sum(tokens) as bigint) as value,
         cast(sum(case when state = 'official' then tokens else 0 end) as bigint) official_tokens,
         cast(sum(case when state = 'tail' then tokens else 0 end) as bigint) local_tail_tokens,
         cast(sum(case when state in ('only', 'gap') then tokens else 0 end) as bigint) local_only_tokens,
         case when count(*) filter (state = 'official') = 4 then 'exact_official' when count(*) filter (state = 'only') > 0 then 'local_only_account'
              when count(*) filter (state = 'gap') > 0 or count(*) < 4 then 'unknown' when count(*) filter (state = 'tail') > 0 then 'local_tail' else 'unknown' end status,
         count(*) filter (state = 'official') covered_accounts, cast(4 as bigint) known_accounts
  from account_days group by day""",
    "residual_rows": f"""
  select d.account, d.local_day as day,
         case when s.thread_id is not null then 'standalone' when d.project_id = '' then 'unassigned' else d.project_id end project, d.model, {CUBE}
  from days d left join standalone s using (thread_id)
  where d.quality = 'confirmed' and d.account in ('acct-a', 'acct-b') group by all""",
    "excess": """
  select *, row_number() over (partition by account, day order by project, model) nth from (
    select r.*, greatest(cast(sum(r.total) over (partition by r.account, r.day) as bigint) - o.tokens, 0) residual
    from residual_rows r join official o on o.account = r.account and o.day = r.day) where residual > 0""",
    "weights": """
  select account, day, project, model, event_count, cache_write_observed, residual, part, weight from (
    select *, unnest([0, 1, 2, 3, 4]) part,
           unnest([least(cached_input, input), least(cache_write_input, greatest(input - cached_input, 0)), greatest(input - cached_input - cache_write_input, 0),
                   least(reasoning_output, output), greatest(output - reasoning_output, 0)]) weight from excess)""",
    "bases": """
  select *, cast(weight as hugeint) * target // whole base, cast(weight as hugeint) * target % whole rest from (
    select *, sum(weight) over (partition by account, day) whole, least(residual, cast(sum(weight) over (partition by account, day) as bigint)) target from weights) where whole > 0""",
    "shares": """
  select *, cast(base + case when row_number() over (partition by account, day order by rest desc, project, model, part)
                              <= target - sum(base) over (partition by account, day) then 1 else 0 end as bigint) allocated from bases""",
    "allocated": """
  select account, day, project, model, event_count, cached + written + uncached as input, cached cached_input, written cache_write_input,
         case when cache_write_observed > 0 then cached + written + uncached else 0 end cache_write_observed,
         reasoning + other as output, reasoning reasoning_output, cached + written + uncached + reasoning + other total from (
    select account, day, project, model, event_count, cache_write_observed,
           cast(sum(allocated) filter (part = 0) as bigint) cached, cast(sum(allocated) filter (part = 1) as bigint) written,
           cast(sum(allocated) filter (part = 2) as bigint) uncached, cast(sum(allocated) filter (part = 3) as bigint) reasoning,
           cast(sum(allocated) filter (part = 4) as bigint) other from shares group by all)
  where cached + written + uncached + reasoning + other > 0""",
    "epochs": """
  select *, sum(case when k = 0 then 1 else 0 end) over (partition by thread_id order by source_timestamp, event_id) epoch from facts""",
    "counters": "\n  select thread_id, source_timestamp, event_id, cast(epoch as bigint) epoch, "
    + ", ".join(f"cast(sum(case when event_type <> 'view' then {m} else 0 end) over (partition by thread_id, epoch order by source_timestamp, event_id) as bigint) {m}" for m in MEASURES)
    + " from epochs",
    "quota": """
  select account, source_timestamp observed_at, event_id, cast(k as double) used_percent, cast(432000 as bigint) window_seconds,
         cast(date '2024-01-01' + cast(floor(date_diff('day', date '2024-01-01', cast(source_timestamp as date)) / 5) * 5 + 5 as int) as timestamp) resets_at
  from facts where event_type = 'signup' and account is not null""",
    "markers": """
  select event_id, source_timestamp observed_at, case when k <= 2 then 'logout' when k <= 5 then 'login_success' else 'account_seen' end kind,
         case when k >= 6 then account end account from facts where event_type = 'error' and k < 10""",
    "logouts": """
  select observed_at from (select distinct observed_at from markers where kind = 'logout') where observed_at > (select min(source_timestamp) from facts)""",
    "windows": f"""
  select observed_at s, coalesce(lead(observed_at) over (order by observed_at), {T} + interval 3650 day) e
  from (select min(source_timestamp) observed_at from facts union all select observed_at from logouts)""",
    "inferred": f"""
  select coalesce((select max(m.observed_at) from markers m where m.kind = 'login_success' and m.observed_at >= s and m.observed_at <= first_seen), s) observed_from,
         case when e <= {T} then e end observed_to, account from (
    select s, e, min(account) account, min(observed_at) first_seen from windows join markers m on m.observed_at >= s and m.observed_at < e
    where m.kind = 'account_seen' and m.account is not null group by s, e having count(distinct account) = 1)""",
    "readings": "select *, row_number() over (partition by account order by observed_at, event_id) n from quota",
    "sure": """
  select a.*, exists (select 1 from readings b where b.account = a.account and b.resets_at is not distinct from a.resets_at and b.n > a.n
    and b.observed_at <= a.observed_at + interval 600 second and b.used_percent <= a.used_percent + 2) confirmed from readings a""",
    "walk": f"""
  select account, n, used_percent high, resets_at high_reset, observed_at, event_id, used_percent, resets_at, cast(null as double) before_used, cast(null as timestamp) previous_reset, false hit from sure where n = 1
  union all
  select s.account, s.n, case when s.used_percent >= w.high or {HIT} then s.used_percent else w.high end, case when s.used_percent >= w.high or {HIT} then s.resets_at else w.high_reset end,
         s.observed_at, s.event_id, s.used_percent, s.resets_at, w.high, w.high_reset, {HIT} from walk w join sure s on s.account = w.account and s.n = w.n + 1""",
    "resets": """
  select account, observed_at as at, event_id, before_used, used_percent after_used, previous_reset, resets_at next_reset,
         case when epoch_us(observed_at) - epoch_us(previous_reset) between -600000000 and 1800000000 then 'scheduled_rollover' else 'observed_official_reset' end reset_class
  from walk where hit""",
    "paired": f"""
  select c.thread_id, c.event_id, c.source_timestamp, f.parent_thread_id, {_each("c.@ t_@")}, {_each("f.@ l_@")}, {_each("lag(c.@) over w p_@")}, lag(c.source_timestamp) over w before_at
  from counters c join facts f on f.event_id = c.event_id window w as (partition by c.thread_id order by c.event_id)""",
    "guard": f"""
  select thread_id source, event_id line_no, source_timestamp as at, thread_id, parent_thread_id parent_id, cast(null as varchar) model, cast(null as varchar) cwd, quality, reason, counter_epoch, {_each("l_@ @")}
  from (select *, cast(sum(case when falls then 1 else 0 end) over (partition by thread_id order by event_id) as int) counter_epoch, case when sound then 'confirmed' else 'quarantined' end quality,
               case when not sound then 'last_usage_invalid' when falls then 'counter_reset' when before_at is not null and ({_each("t_@ - p_@ <> l_@", " or ")}) then 'delta_differs' end reason
        from (select *, before_at is not null and ({_each("t_@ < p_@", " or ")}) falls, before_at is not null and ({_each("t_@ = p_@", " and ")}) same, {_valid("l_")} sound from paired))
  where not same and not (quality = 'confirmed' and {_each("l_@ = 0", " and ")})""",
    "metered": f"""
  select *, sum(case when near then 0 else 1 end) over (partition by thread_id order by event_id) broken, {_each("d_@ >= 0", " and ")} and (before_at is null or {_valid("d_")}) rises
  from (select p.*, {_each("coalesce(t_@ - p_@, t_@) d_@")}, greatest(epoch_ms(p.source_timestamp) - epoch_ms(coalesce(before_at, k.created_at)), 0) <= 2000 near
        from paired p join catalog k on k.thread_id = p.thread_id where {_valid("t_")})""",
    "remade": f"""
  select thread_id source, event_id line_no, source_timestamp as at, thread_id, cast(null as varchar) model, cast(null as varchar) cwd, counter_epoch, {_each("case when rises then d_@ else l_@ end @")}
  from (select *, parent_thread_id is not null and broken = 0 prefix,
               cast(sum(case when not (parent_thread_id is not null and broken = 0) and not rises then 1 else 0 end) over (partition by thread_id order by event_id) as int) counter_epoch from metered)
  where not prefix and (rises or {_valid("l_")}) and not ({_each("case when rises then d_@ else l_@ end = 0", " and ")})""",
}


RELATIONS |= {
    "logout_chains": """
  select observed_at, sum(begins) over (order by observed_at) chain from (
    select observed_at, case when observed_at < lag(observed_at) over (order by observed_at) + interval 2 second then 0 else 1 end begins
    from (select distinct observed_at from markers where kind = 'logout'))""",
    "kept_logouts": """
  select chain, min(observed_at) observed_at from logout_chains group by 1
  union all
  select k.chain, min(c.observed_at) from kept_logouts k join logout_chains c on c.chain = k.chain and c.observed_at >= k.observed_at + interval 2 second group by 1""",
    "thinned_windows": RELATIONS["windows"].replace("from logouts", "from kept_logouts where observed_at > (select min(source_timestamp) from facts)"),
    "thinned": RELATIONS["inferred"].replace("from windows", "from thinned_windows"),
}


def sql(query: str) -> str:
    """A query with the relations that it reads, as common tables."""
    wanted: list[str] = []

    def want(text: str) -> None:
        for name in RELATIONS:
            if name not in wanted and re.search(rf"\b(from|join)\s+{name}\b", text):
                wanted.append(name)
                want(RELATIONS[name])

    want(query)
    order = sorted(wanted, key=list(ORDER).index)
    return "with recursive " + ",\n".join(f"{n} as ({RELATIONS[n]})" for n in order) + "\n" + query if order else query


#: Definitions come after what they read.
ORDER = (
    "raw_events", "facts", "recon", "days", "hours", "recon_days", "recon_hours", "catalog", "tree", "member", "standalone", "selection",
    "eff_days", "eff_hours", "eff_facts", "official", "coverage", "grid", "account_days", "reconciled", "residual_rows", "excess", "weights",
    "bases", "shares", "allocated", "epochs", "counters", "quota", "markers", "logouts", "windows", "inferred", "logout_chains", "kept_logouts", "thinned_windows", "thinned", "readings", "sure", "walk", "resets", "paired", "guard", "metered", "remade",
)
