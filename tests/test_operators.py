"""Attribution, reconciliation, quota and trees on small inputs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from meterline.operators import attribution, maintenance, official, quota, trees

DAY = datetime(2026, 8, 1)


def shares(weights: list[int], target: int) -> list[int]:
    whole = sum(weights)
    if not whole:
        return [0] * len(weights)
    exact = [Fraction(w * target, whole) for w in weights]
    out = [int(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (-(exact[i] - out[i]), i))[: target - sum(out)]:
        out[i] += 1
    return out


@pytest.mark.parametrize(("weights", "target"), [([1, 1, 1], 2), ([5, 0, 3, 7], 11), ([0, 0], 4), ([2**62, 2**61, 3], 2**62 + 1), ([1], 9), ([3, 3, 3, 1], 7)])
def test_apportionment_is_exact(spark, weights, target):
    rows = spark.createDataFrame([("g", i, w, target) for i, w in enumerate(weights)], "g string, i int, weight long, target long")
    got = [r.allocated for r in official.apportioned(rows, ["g"], ["i"], "weight", "target").orderBy("i").collect()]
    assert got == shares(weights, target)


def test_reset_events(spark):
    def rows(account, *readings):
        return [(account, DAY + timedelta(minutes=m), i, float(u), DAY + timedelta(minutes=b)) for i, (m, u, b) in enumerate(readings)]

    readings = (
        rows("due", (0, 98, 60), (61, 2, 10000), (62, 3, 10000))
        + rows("early", (0, 91, 5000), (10, 4, 9000), (12, 5, 9000))
        + rows("noise", (0, 45, 5000), (1, 44, 5000), (2, 45, 5000))
        + rows("alone", (0, 90, 5000), (10, 4, 9000), (40, 5, 9000), (41, 91, 9000))
        + rows("rises", (0, 90, 5000), (10, 4, 9000), (12, 50, 9000))
    )
    frame = spark.createDataFrame(readings, "account string, observed_at timestamp_ntz, event_id long, used_percent double, resets_at timestamp_ntz")
    got = {(r.account, r.reset_class, r.before_used, r.after_used) for r in quota.reset_events(frame).collect()}
    assert got == {("due", "scheduled_rollover", 98.0, 2.0), ("early", "observed_official_reset", 91.0, 4.0)}


def test_current_cycle(spark):
    rows = [("a", DAY + timedelta(hours=h), i, u, DAY + timedelta(days=b), 432000) for i, (h, u, b) in enumerate([(0, 80.0, 1), (30, 20.0, 6), (40, 25.0, 6)])]
    c = quota.current_cycle(spark.createDataFrame(rows, "account string, observed_at timestamp_ntz, event_id long, used_percent double, resets_at timestamp_ntz, window_seconds long")).first()
    assert (c.samples, c.used_delta, c.cycle_start, c.local_start) == (2, 5.0, DAY + timedelta(days=1), DAY + timedelta(hours=30))


def test_epochs_prefer_confidence_then_start(spark):
    facts = spark.createDataFrame([(i, DAY + timedelta(hours=h)) for i, h in enumerate((1, 30, 60, 100))], "event_id long, source_timestamp timestamp_ntz")
    epochs = spark.createDataFrame(
        [(DAY, DAY + timedelta(hours=50), "a", "verified"), (DAY + timedelta(hours=20), DAY + timedelta(hours=70), "b", "inferred"), (DAY + timedelta(hours=90), None, "c", "unknown")],
        "observed_from timestamp_ntz, observed_to timestamp_ntz, account string, confidence string",
    )
    got = {r.event_id: r.epoch_account for r in attribution.epoch_at(facts, epochs).collect()}
    assert got == {0: "a", 1: "a", 2: "b", 3: "c"}


def test_epochs_from_markers(spark):
    at = lambda h: DAY + timedelta(hours=h)
    rows = [(0, at(1), "account_seen", "a"), (1, at(2), "logout", None), (2, at(2) + timedelta(milliseconds=500), "logout", None), (3, at(3), "account_seen", "b"), (4, at(4), "logout", None), (5, at(5), "login_success", None), (6, at(6), "account_seen", "a")]
    markers = spark.createDataFrame(rows, "event_id long, observed_at timestamp_ntz, kind string, account string")
    now = F.lit(str(at(100))).cast("timestamp_ntz")
    got = attribution.inferred_epochs(markers, F.lit(str(DAY)).cast("timestamp_ntz"), now).orderBy("observed_from").collect()
    assert [(r.observed_from, r.observed_to, r.account) for r in got] == [(DAY, at(2), "a"), (at(2), at(4), "b"), (at(5), None, "a")]


def test_longest_root(spark):
    threads = spark.createDataFrame([("1", "/a/b/c"), ("2", "/a/bc"), ("3", None), ("4", "/a/b/../x")], "thread_id string, cwd string")
    roots = spark.createDataFrame([("/a", "p"), ("/a/b/", "q"), ("/a/b", "r")], "path string, project_id string")
    assert {r.thread_id: r.root_project for r in attribution.longest_root(threads, roots).collect()} == {"1": "q", "2": "p", "4": "p"}


def test_trees_with_chains_cycles_and_orphans(spark):
    rows = [("a", None), *[(f"n{i}", f"n{i - 1}" if i else "a") for i in range(40)], ("x", "y"), ("y", "x"), ("o", "gone")]
    catalog = spark.createDataFrame([(t, p, 0, None, "native") for t, p in rows], "thread_id string, parent_thread_id string, depth int, project_id string, source_kind string")
    got = {r.thread_id: (r.root_id, r.relative_depth) for r in trees.roots(catalog).collect()}
    assert got == {"a": ("a", 0), **{f"n{i}": ("a", i + 1) for i in range(32)}}
    assert trees.standalone(catalog).count() == 41
    assert {r.thread_id for r in trees.descendants(catalog, "x").collect()} == {"x", "y"}
    pairs = trees.ancestors(catalog).where("thread_id = 'n5'").collect()
    assert {(p.ancestor_id, p.distance) for p in pairs} == {("a", 6), *[(f"n{i}", 5 - i) for i in range(6)]}


def test_coverage_is_the_intersection(spark):
    days = spark.createDataFrame([("a", "2026-08-31", 10), ("a", "2026-09-01", 10), ("b", "2026-08-31", 10)], "account string, day string, tokens long")
    covered = official.coverage(days)
    accounts = spark.createDataFrame([("a",), ("b",)], "account string")
    local = spark.createDataFrame([("b", "2026-09-01", 120)], "account string, day string, tokens long")
    got = official.reconciled(official.account_days(accounts, "2026-08-31", "2026-09-02", days, local, covered), 2).orderBy("day").collect()
    assert [(r.value, r.status, r.covered_accounts) for r in got] == [(20, "exact_official", 2), (130, "local_tail", 1)]
    assert tuple(official.common_coverage(covered, 2).first()) == ("2026-08-31", "2026-08-31")
    assert tuple(official.common_coverage(covered, 3).first()) == (None, None)


def test_repeats_and_remaps(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x")], "k string, n int, payload string")
    assert [r.n for r in maintenance.without_repeats(rows, "k", "payload", "n").orderBy("n").collect()] == [1, 3, 4]


def test_newest_readings_are_as_many_as_the_reference_lists(spark):
    frame = spark.range(2200).selectExpr("concat('a', id % 2) account", "timestamp_ntz'2026-08-01' + make_dt_interval(0, 0, id div 4) observed_at", "id event_id")
    got = {(r.account, r.event_id) for r in quota.newest(frame).collect()}
    assert got == {(f"a{i % 2}", i) for i in range(200, 2200)}
    assert quota.newest(frame, 20).count() == 40


def test_resets_have_a_high_water_for_each_window(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    data = [("a", "primary", at(0), 1, 80.0, at(30)), ("a", "secondary", at(1), 2, 10.0, at(50)), ("a", "primary", at(2), 3, 5.0, at(40)), ("a", "secondary", at(3), 4, 11.0, at(50)), ("a", "primary", at(4), 5, 6.0, at(40))]
    frame = spark.createDataFrame(data, "account string, window_name string, o string, event_id long, used_percent double, r string").selectExpr("account", "window_name", "cast(o as timestamp_ntz) observed_at", "event_id", "used_percent", "cast(r as timestamp_ntz) resets_at")
    got = [(r.window_name, r.event_id, r.before_used) for r in quota.reset_events(frame, ("account", "window_name")).collect()]
    assert got == [("primary", 3, 80.0)]


def test_confirmation_by_readings_of_the_same_time(spark):
    data = [("a", "2024-01-01 00:00:00", 1, 80.0, 1), ("a", "2024-01-01 00:05:00", 2, 5.0, 2), ("a", "2024-01-01 00:05:00", 3, 6.0, 2)]
    frame = spark.createDataFrame(data, "account string, o string, event_id long, used_percent double, d int").selectExpr("account", "cast(o as timestamp_ntz) observed_at", "event_id", "used_percent", "cast(date_add(date'2024-01-01', d) as timestamp_ntz) resets_at")
    assert [r.event_id for r in quota.reset_events(frame).collect()] == [2]
    assert not quota.reset_events(frame.where("event_id < 3")).collect()


def test_gap_buckets_add_up(spark):
    from meterline.operators import official

    days = spark.createDataFrame([("a", "2024-01-01", 5), ("b", "2024-01-01", 2), ("a", "2024-01-03", 4), ("a", "2024-01-04", 9)], "account string, day string, tokens long")
    seen = spark.createDataFrame([("2024-01-02",), ("2024-01-04",)], "day string")
    shown, local = spark.range(1).selectExpr("25 display_tokens"), spark.range(1).selectExpr("10 total")
    r = official.gap_buckets(days, seen, shown, local).first()
    assert (r.before_evidence, r.without_evidence, r.gap, r.rest) == (7, 4, 15, 4)
    none = official.gap_buckets(days, seen.where("false"), shown, local).first()
    assert (none.before_evidence, none.without_evidence) == (20, 0)


def test_strict_usage_takes_numbers_only(spark):
    from meterline.functions.tokens import valid
    from meterline.sources import logs

    texts = ['{"u":{"input_tokens":8,"output_tokens":2,"total_tokens":10,"cache_write_input_tokens":3}}', '{"u":{"input_tokens":"8","output_tokens":2,"total_tokens":10}}', '{"u":{"input_tokens":8,"output_tokens":2}}', '{"u":{"input_tokens":8.0,"output_tokens":-2,"total_tokens":8}}', "no json", None, '{"u":{"input_tokens":8,"total_tokens":8,"cache_write_input_tokens":null}}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, line string").select("id", *logs.strict_usage("$.u"))
    got = {r.id: (r.input, r.cache_write_input, r.cache_write_observed, r.total) for r in frame.where(valid()).where("total > 0").collect()}
    assert got == {0: (8, 3, 8, 10), 6: (8, 0, 0, 8)}


def test_labels_of_windows(spark):
    from meterline.functions import time

    rows = spark.createDataFrame([(2880,), (1500,), (120,), (90,), (0,)], "m int").select(time.duration_label("m").alias("x"))
    assert [r.x for r in rows.collect()] == ["2 days", "25 hours", "2 hours", "90 minutes", "0 minutes"]
    at = spark.sql("select timestamp_ntz'2023-12-31 15:00:00' a, timestamp_ntz'2023-12-31 17:00:00' b, cast(null as timestamp_ntz) c")
    zone = "Asia/Shanghai"
    assert at.select(time.crosses("a", "b", zone), time.crosses("a", "b", zone, year=True), time.crosses("a", "b", "UTC"), time.crosses("c", "b", zone)).first() == (True, True, False, False)


def test_sums_that_overflow_are_errors(spark):
    from meterline.functions.tokens import MEASURES
    from meterline.operators import aggregates

    rows = spark.createDataFrame([(1 << 62, 1)] * 3, "total long, event_count long").withColumns({m: F.lit(0).cast("long") for m in MEASURES if m != "total"})
    assert aggregates.totals(rows.limit(1)).first().total == 1 << 62
    for sums in (aggregates.totals(rows), aggregates.cube_totals(rows)):
        with pytest.raises(Exception, match="(?i)overflow"):
            sums.collect()


def test_points_are_exported_as_csv_and_json(spark, data, tmp_path):
    from meterline.plans import catalogue, sections, views  # noqa: F401

    points = catalogue.QUERIES["export_points"](spark, data)
    expected = sorted(tuple(r) for r in points.collect())
    views.export(points, str(tmp_path / "csv"))
    views.export(points, str(tmp_path / "json"), "json")
    assert sorted(tuple(r) for r in spark.read.schema(points.schema).option("header", "true").csv(str(tmp_path / "csv")).collect()) == expected
    assert sorted(tuple(r) for r in spark.read.schema(points.schema).json(str(tmp_path / "json")).collect()) == expected and expected


def test_the_last_assignment_by_hand_counts(spark):
    from datetime import datetime

    from meterline.operators import maintenance

    day = lambda n: datetime(2024, 1, n)
    rows = [("a", "p", day(1), 1), ("a", "q", day(2), 2), ("b", "p", day(1), 3), ("b", None, day(3), 4), ("c", "p", day(1), 5), ("c", "q", day(1), 6)]
    got = maintenance.assigned(spark.createDataFrame(rows, "thread_id string, project_id string, assigned_at timestamp_ntz, event_id long")).collect()
    assert sorted((r.thread_id, r.project_id) for r in got) == [("a", "q"), ("c", "q")]


def test_trees_are_searched_by_what_threads_are_called(spark):
    from meterline.plans import views

    rows = [("r", None, "Plan", None, "m1"), ("a", "r", "Write", "Ada", "m2"), ("b", "a", "Read", None, None), ("c", "r", None, None, "M2")]
    catalog = spark.createDataFrame(rows, "thread_id string, parent_thread_id string, title string, nickname string, model string")
    found = lambda part: {r.thread_id: r.hit for r in views.search_fields(catalog, part, "title", "nickname", "model").collect()}
    assert found(" ADA ") == {"a": True, "r": False} and found("m2") == {"a": True, "c": True, "r": False} and found("read") == {"b": True, "a": False, "r": False} and found("zz") == {}
    assert sorted(r.thread_id for r in views.focus(catalog, "a").collect()) == ["a", "b"]


@pytest.mark.parametrize("seed", range(3))
def test_readings_left_out_change_no_reset(spark, seed, monkeypatch):
    """Resets with the readings that tell something are those with all readings: repeats, dips, ties, nulls, any boundary."""
    draw = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows, at, used = [], 0, 10.0
    for i in range(1500):
        at += draw.choice([0, 60, 60, 300, 900])
        used = draw.choice([used, used, used, min(used + draw.choice([1.0, 2.0, 7.0]), 100.0), max(used - draw.choice([1.0, 6.0, 40.0]), 0.0)])
        boundary = draw.choice([start + timedelta(hours=5 * (at // 18000 + 1)), start + timedelta(hours=5 * (at // 18000 + 1)), start + timedelta(days=1), None])
        rows.append((draw.choice("ab"), start + timedelta(seconds=at), i, draw.choice([used] * 20 + [None, float("nan")]), boundary))
    readings = spark.createDataFrame(rows, "account string, observed_at timestamp_ntz, event_id long, used_percent double, resets_at timestamp_ntz")
    found = lambda: sorted((tuple(r) for r in quota.reset_events(readings).collect()), key=str)
    thinned = found()
    kept = []

    def all_rows(df, *keys):
        kept.append((quota_telling(df, *keys).count(), df.count()))
        return df

    quota_telling = quota.telling
    monkeypatch.setattr(quota, "telling", all_rows)
    assert found() == thinned and len(thinned) > 5 and kept[0][0] < kept[0][1]
