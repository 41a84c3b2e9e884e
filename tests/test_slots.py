"""Neighbours in time by hour slots, against the same over sorted lists."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterline.operators import attribution, quota
from meterline.operators.slots import carried, neighbour

DAY = datetime(2024, 1, 1)
SCHEMA = "source_id string, event_id long, observed_at timestamp_ntz, account string"


def some(seed: int, n: int = 300):
    draw = random.Random(seed)
    at = lambda: DAY + timedelta(seconds=draw.choice([draw.randrange(4000), draw.randrange(400_000)]))
    return [(draw.choice("ab"), i, None if draw.random() < 0.03 else at(), draw.choice(["x", "y", None])) for i in range(n)]


def key(r):
    return (r[2] is not None, r[2] or DAY, r[1])


@pytest.mark.parametrize("after", [False, True])
def test_neighbours_are_those_of_the_sorted_rows(spark, after):
    rows = some(1)
    got = neighbour(spark.createDataFrame(rows, SCHEMA), ["event_id"], ["observed_at", "event_id"], ("source_id",), after).collect()
    expected = {}
    for s in "ab":
        own = [r[1] for r in sorted((r for r in rows if r[0] == s), key=key)]
        for i, e in enumerate(own):
            j = i + 1 if after else i - 1
            expected[e] = own[j] if 0 <= j < len(own) else None
    assert {r.event_id: r.near.event_id if r.near else None for r in got} == expected and len(got) == len(rows)


def test_values_are_carried_over_hours_without_any(spark):
    rows, last, expected = some(2), None, {}
    for r in sorted(rows, key=key):
        last = r[3] or last
        expected[r[1]] = last
    got = carried(spark.createDataFrame(rows, SCHEMA), {"account": "was", "source_id": "of"}, ["observed_at", "event_id"]).collect()
    assert {r.event_id: r.was for r in got} == expected


def test_values_are_carried_to_rows_of_equal_times(spark):
    """Each time has many rows, also at the ends of hours; values are told apart from rows that have none by their rank."""
    at = lambda i: DAY + timedelta(minutes=7 * i)
    rows = [("a", 100 * i + n, at(i), f"v{i}" if i % 11 == 0 and n == 0 else None) for i in range(60) for n in range(40)]
    ranked = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.when(F.col("account").isNull(), 1).otherwise(0))
    got = carried(ranked.repartition(7), {"account": "was"}, ["observed_at", "rank"]).collect()
    assert {r.event_id: r.was for r in got} == {e: f"v{e // 100 // 11 * 11}" for _, e, _, _ in rows} and len(got) == len(rows)


def test_switches_are_those_of_the_sorted_rows(spark):
    rows, expected = some(3), set()
    for s in "ab":
        own = sorted((r for r in rows if r[0] == s), key=key)
        expected |= {(b[1], a[3], b[3]) for a, b in zip(own, own[1:]) if a[3] is not None and a[3] != b[3]}
    got = quota.switches(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.event_id, r.before, r.account) for r in got} == expected


def test_times_kept_apart_by_the_greedy_rule(spark):
    draw = random.Random(4)
    times = [DAY + timedelta(milliseconds=draw.choice([draw.randrange(100_000), draw.randrange(10**8)])) for _ in range(300)]
    last, expected = None, []
    for t in sorted(set(times)):
        if last is None or int((t - last).total_seconds()) > 1:
            expected.append(t)
            last = t
    rows = spark.createDataFrame([(t,) for t in [*times, None]], "observed_at timestamp_ntz")
    assert sorted(r[0] for r in attribution.kept_apart(rows, "observed_at", 1).collect()) == expected


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quota.switches(none).collect() == [] and attribution.kept_apart(none, "observed_at", 1).collect() == []
    markers = none.withColumn("kind", F.lit("logout"))
    assert attribution.inferred_epochs(markers, F.lit(str(DAY)).cast("timestamp_ntz"), F.lit(str(DAY)).cast("timestamp_ntz")).collect() == []


def test_epochs_are_those_of_a_nested_loop(spark):
    draw = random.Random(5)
    kinds = ["logout", "account_seen", "account_seen", "login_success"]
    rows = [(i, DAY + timedelta(seconds=draw.randrange(300_000)), draw.choice(kinds), draw.choice("aab")) for i in range(250)]
    earliest, now = DAY + timedelta(seconds=20_000), DAY + timedelta(seconds=290_000)
    logouts, last = [], None
    for t in sorted({r[1] for r in rows if r[2] == "logout"}):
        if last is None or (t - last).total_seconds() >= 2:
            logouts.append(t)
            last = t
    bounds, expected = [earliest, *[t for t in logouts if t > earliest]], set()
    for start, end in zip(bounds, [*bounds[1:], datetime(2100, 1, 1)]):
        inside = [r for r in rows if start <= r[1] < end]
        seen = [r for r in inside if r[2] == "account_seen"]
        if len({r[3] for r in seen}) == 1:
            logins = [r[1] for r in inside if r[2] == "login_success" and r[1] <= min(s[1] for s in seen)]
            expected.add((max(logins, default=start), end if end <= now else None, seen[0][3]))
    markers = spark.createDataFrame(rows, "event_id long, observed_at timestamp_ntz, kind string, account string")
    at = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    got = attribution.inferred_epochs(markers, at(earliest), at(now)).collect()
    assert {(r.observed_from, r.observed_to, r.account) for r in got} == expected and len(expected) > 5


def test_epochs_are_the_same_whatever_the_number_of_equal_markers(spark):
    draw = random.Random(7)
    rows = [(i, DAY + timedelta(seconds=draw.randrange(300_000)), draw.choice(["logout", "account_seen", "account_seen", "login_success"]), draw.choice("aab")) for i in range(250)]
    schema, at = "event_id long, observed_at timestamp_ntz, kind string, account string", lambda s: F.lit(str(DAY + timedelta(seconds=s))).cast("timestamp_ntz")
    once, often = (spark.createDataFrame(r, schema) for r in (rows, [(1000 * n + r[0], *r[1:]) for n in range(20) for r in rows]))
    expected, got = (sorted(attribution.inferred_epochs(m, at(0), at(290_000)).collect(), key=str) for m in (once, often.repartition(5)))
    assert got == expected and len(got) > 5


def test_epochs_read_the_events_twice(spark, data):
    from meterline.plans.ledger import Ledger
    from meterline.sources import ledger as source

    own = Ledger(spark, data)
    epochs = attribution.inferred_epochs(source.auth_markers(own.facts), source.now(), source.now())
    plan = epochs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2 and plan.count("Window ") <= 16 and plan.count("Join ") == 0
    looked_up = attribution.epoch_at(own.facts, own.epochs)._jdf.queryExecution().optimizedPlan().toString()
    assert looked_up.count("Relation [") == 1


def test_cycle_is_that_of_the_readings_after_the_last_other_boundary(spark):
    draw = random.Random(6)
    schema = "account string, event_id long, observed_at timestamp_ntz, used_percent double, window_seconds long, resets_at timestamp_ntz"
    rows = [(draw.choice(["a", "b", None]), i, DAY + timedelta(seconds=draw.randrange(5000)), float(i), 60, draw.choice([None, DAY, DAY + timedelta(days=1)])) for i in range(60)]
    got = {r.account: (r.first_at, r.last_at, r.resets_at, r.samples) for r in quota.current_cycle(spark.createDataFrame(rows, schema)).collect()}
    for account in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == account), key=lambda r: (r[2], r[1]))
        cycle = [own.pop()]
        while own and own[-1][5] == cycle[-1][5]:
            cycle.append(own.pop())
        assert got[account] == (cycle[-1][2], cycle[0][2], cycle[0][5], len(cycle))
