"""Sections, issues, orders, revisions and the thread index against plain versions."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterline.functions.tokens import MEASURES
from meterline.operators import official, sections, trees
from meterline.operators.order import numbered
from meterline.plans import sections as plans
from meterline.plans.ledger import Ledger
from meterline.sources import index

DAY = datetime(2024, 1, 1)


def test_sections_add_up_in_windows_that_overlap(spark):
    draw = random.Random(1)
    rows = [(f"2024-01-{draw.randrange(1, 9):02}", draw.choice("pq"), draw.choice("mn"), draw.choice("ab"), draw.choice(["confirmed", "unknown"]), 1, *[draw.randrange(9) for _ in MEASURES]) for _ in range(200)]
    cube = spark.createDataFrame(rows, "local_day string, project string, model string, account string, quality string, event_count long, " + ", ".join(f"{m} long" for m in MEASURES))
    windows = {"one": ("2024-01-02", "2024-01-05"), "two": ("2024-01-04", "2024-01-07")}
    got = sections.sections(cube, windows).collect()
    for part, (a, b) in windows.items():
        own = [r for r in rows if a <= r[0] <= b]
        of = lambda name: [r for r in got if r.section == name and r.part == part]
        for name, keys in sections.SECTIONS.items():
            assert sum(r.event_count for r in of(name)) == len(own) and sum(r.total for r in of(name)) == sum(r[-1] for r in own)
            assert all((getattr(r, k) is None) == (k not in keys) for r in of(name) for k in sections.KEYS)
        assert {(r.project, r.quality): r.input for r in of("by_project")} == {(p, q): sum(r[6] for r in own if r[1] == p and r[4] == q) for p in "pq" for q in ("confirmed", "unknown")}
    assert sections.sections(cube.limit(0), windows).count() == 0


def test_the_dashboard_reads_its_cube_once(spark, data):
    x = Ledger(spark, data)
    x.standalone, x.effective_days  # noqa: B018  (settled before)
    cube = spark.createDataFrame([], x.effective_days.schema).withColumn("project", F.lit("p"))
    plan = sections.sections(cube, plans._WEEK)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1 and plan.count("Expand") <= 1
    whole = sections.sections(plans._classified(x, x.effective_days), plans._WEEK)._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("Relation [") == x.effective_days._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_issues_are_the_rules_that_hit(spark):
    state = lambda **c: spark.createDataFrame([tuple(c.get(n, 0) for n in NAMES)], ", ".join(f"{n} long" for n in NAMES))
    NAMES = ("quarantined", "quarantined_tokens", "unknown", "missing_accounts", "provisional", "provisional_tokens", "pending", "unrecoverable")
    found = lambda s: [(r.id, r.severity, r.n, r.event_count, r.token_count) for r in sections.issues(s, F.lit("a"), F.lit("b")).orderBy("id").collect()]
    assert found(state()) == []
    assert found(state(quarantined=3, quarantined_tokens=9)) == [("quarantined-events", "critical", 3, 3, 9)]
    everything = found(state(**{n: i + 1 for i, n in enumerate(NAMES)}))
    assert [i for i, *_ in everything] == sorted(r[0] for r in sections.RULES) and ("provisional-account-identities", "warning", 5, 0, 6) in everything


@pytest.mark.parametrize("seed", range(3))
def test_preorder_is_that_of_a_walk(spark, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(120):
        parent = None if i < 3 else draw.choice([0, draw.randrange(i), draw.randrange(max(i - 3, 0), i)])
        rows.append((f"t{i}", None if parent is None else f"t{parent}", DAY + timedelta(hours=draw.randrange(30), minutes=draw.choice([0, draw.randrange(60)]))))
    rows += [("x1", "x2", DAY), ("x2", "x1", DAY), ("lost", "nowhere", DAY)]
    catalog = spark.createDataFrame(rows, "thread_id string, parent_thread_id string, updated_at timestamp_ntz")
    got = {r.thread_id: (r.root_id, r.position, r.subtree_size, r.relative_depth) for r in trees.preorder(catalog, trees.roots(catalog)).collect()}
    expected = {}

    def walk(t, root, depth, n):
        at = n
        n += 1
        for c in sorted((r for r in rows if r[1] == t), key=lambda r: (-r[2].timestamp(), r[0])):
            n = walk(c[0], root, depth + 1, n)
        expected[t] = (root, at, n - at, depth)
        return n

    for i in range(3):
        walk(f"t{i}", f"t{i}", 0, 0)
    assert got == {t: v for t, v in expected.items() if v[3] <= trees.MOST_LEVELS} and len(got) >= 100


def test_places_in_an_order_of_all_rows(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as k").repartition(5)
    placed = numbered(df, F.desc("k"), F.col("id")).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(500)) and [r.id for r in placed] == sorted(range(500), key=lambda i: (-(i % 7), i))


def test_revisions_equal_two_readings(spark):
    draw = random.Random(3)
    rows = [(draw.choice("ab"), f"2024-01-{draw.randrange(1, 6):02}", DAY + timedelta(hours=draw.randrange(100)), draw.randrange(3)) for _ in range(80)]
    snapshots = spark.createDataFrame(rows, "account string, day string, observed_at timestamp_ntz, tokens long")
    earlier, later = DAY + timedelta(hours=20), DAY + timedelta(hours=70)
    at = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    one, two = ({(r.account, r.day): r.tokens for r in official.as_of(snapshots, at(t)).collect()} for t in (earlier, later))
    want = {(k, one.get(k), two[k], two[k] - (one.get(k) or 0)) for k in two if one.get(k) != two[k]}
    assert {((r.account, r.day), r.before, r.after, r.delta) for r in official.revised(snapshots, at(earlier), at(later)).collect()} == want and want


def test_deltas_need_both_ranges(spark):
    days = spark.createDataFrame([("a", "2024-01-03", 10), ("a", "2024-01-05", 30)], "account string, day string, tokens long")
    delta = lambda *r: tuple(official.period_delta(days, *r).first())
    assert delta(("2024-01-05", "2024-01-09"), ("2024-01-01", "2024-01-04")) == (30, 10, 20, 2.0)
    assert delta(("2024-01-04", "2024-01-04"), ("2024-01-01", "2024-01-02")) == (0, None, None, None)  # covered, but without tokens
    assert delta(("2024-02-01", "2024-02-02"), ("2024-01-04", "2024-01-04")) == (None, 0, None, None)


def test_an_index_with_and_without_optional_columns_is_the_same_catalog(spark, tmp_path):
    rows = [(f"t{i}", f"/w/p{i % 3}/x" if i % 3 else "/elsewhere", f"p{i % 3}" if i % 3 else None, f"t{i - 1}" if i % 2 else None) for i in range(12)]
    roots = spark.createDataFrame([("/w/p1", "p1"), ("/w/p2/", "p2")], "path string, project_id string")
    full = spark.createDataFrame([(t, c, p, q, "cli") for t, c, p, q in rows], "id string, cwd string, project_id string, parent_thread_id string, source string")
    spawn = lambda q: json.dumps({"subagent": {"thread_spawn": {"parent_thread_id": q}}}) if q else "cli"
    bare = spark.createDataFrame([(t, c, spawn(q)) for t, c, _, q in rows], "id string, cwd string, source string")
    (tmp_path / "index.jsonl").write_text("\n".join([*[json.dumps({"id": t, "cwd": c, "source": spawn(q), "project_id": ""}) for t, c, _, q in rows], "{broken", '{"no": "id"}', "[]"]))
    key = lambda r: r[0]
    catalogs = [sorted(((r.thread_id, r.parent_thread_id, r.project) for r in index.resolved(index.united(s), roots).collect()), key=key) for s in (full, bare, index.read_json(spark, str(tmp_path / "index.jsonl")))]
    assert catalogs[0] == catalogs[1] == catalogs[2] == sorted(((t, q, p) for t, _, p, q in rows), key=key)
    both = index.united(full.where("id < 't5'"), bare.where("id >= 't5'"))
    assert sorted(((r.thread_id, r.parent_thread_id, r.project) for r in index.resolved(both, roots).collect()), key=key) == catalogs[0]


def test_a_catalog_takes_what_says_most(spark):
    """Sources before columns, milliseconds before seconds, names before titles; unknown projects, times and depths."""
    spawn = lambda **more: json.dumps({"subagent": {"thread_spawn": more}})
    rows = [
        {"id": "a", "cwd": "/w/p1/x", "git_origin": "git@h:o/r.git", "source": "cli", "created_at": 10, "updated_at": 20, "title": "T", "name": " ", "archived": 1},
        {"id": "b", "cwd": "/tmp", "git_origin": "https://h/o/r", "source": spawn(parent_thread_id="a", depth=3, agent_role="r"), "agent_role": "column", "created_at": 10, "created_at_ms": 10500, "title": " "},
        {"id": "c", "cwd": "/w/p1", "project_id": " p9 ", "source": spawn(depth=-1), "created_at": "later", "updated_at": 7, "archived": False},
        {"id": "d", "cwd": "/tmp", "thread_source": "subagent", "source": "{broken", "created_at": 1 << 62, "has_user_event": "maybe"},
        {"id": "e", "cwd": "/w/p1/..", "project_id": "p2", "git_origin": "g", "source": spawn(), "created_at": 0, "updated_at_ms": 1},
        {"id": "f", "git_origin": "g", "source": None, "name": "N", "title": "T"},
        {"id": "g", "cwd": "/w/p1", "project_id": "p2", "source": ""},
    ]
    snapshot = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").select(F.parse_json("value").alias("row"))
    projects = spark.createDataFrame([("p1", "One"), ("p2", "Two")], "project_id string, project_name string")
    roots = spark.createDataFrame([("/w/p1/", "p1")], "path string, project_id string")
    manual = spark.createDataFrame([("g", "p1", None)], "thread_id string, manual_project string, manual_name string")
    got = {r.thread_id: r for r in index.catalog(index.united(snapshot), projects, roots, manual).collect()}
    assert {t: (r.project, r.project_name, r.method, r.confidence) for t, r in got.items()} == {
        "a": ("p1", "One", "root", "inferred"), "b": ("p1", "One", "git", "inferred"), "c": ("p9", None, "native", "verified"), "d": (None, None, "unassigned", "unknown"),
        "e": ("p2", "Two", "native", "verified"), "f": ("p2", "Two", "git", "inferred"), "g": ("p1", "One", "manual", "verified"),
    }
    assert {t: (r.parent_thread_id, r.depth, r.agent_role) for t, r in got.items()} == {"a": (None, 0, None), "b": ("a", 3, "r"), "c": (None, 1, None), "d": (None, 1, None), "e": (None, 1, None), "f": (None, 0, None), "g": (None, 0, None)}
    at = lambda seconds: datetime(1970, 1, 1) + timedelta(seconds=seconds)
    assert {t: (r.created_at, r.updated_at) for t, r in got.items()} == {"a": (at(10), at(20)), "b": (at(10.5), at(10.5)), "c": (None, at(7)), "d": (None, None), "e": (at(0), at(0.001)), "f": (None, None), "g": (None, None)}
    assert [got[t].title for t in "abf"] == ["T", None, "N"] and [got[t].archived for t in "abc"] == [True, None, False] and got["d"].has_user_event is None
    assert index.catalog(index.united(snapshot.limit(0)), projects, roots, manual).count() == 0


def test_the_whole_bundle_reads_the_events_a_few_times(spark, data):
    plan = plans.bundle_values(Ledger(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 6  # besides the cubes, which are made once


def test_figures_of_tables(spark):
    a = spark.createDataFrame([("x", None, 1, 0.5), (None, "y", 2, None)], "k string, l string, n long, r double")
    got = {tuple(r) for r in sections.figures({"one": (a, ("k", "l"), ("n", "r")), "two": (a.agg(F.sum("n").alias("n")), (), ("n",))}).collect()}
    assert got == {("one", "x|", "n", 1.0), ("one", "x|", "r", 0.5), ("one", "|y", "n", 2.0), ("two", "", "n", 3.0)}
