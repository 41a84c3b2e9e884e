"""Scalar functions and periods."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from meterline.functions import payload, text, time, tokens

NOW = datetime(2026, 8, 31, 8, tzinfo=UTC)


@pytest.mark.parametrize(
    ("label", "start", "compare"),
    [
        ("today", "2026-08-30T16", ("2026-08-29T16", "2026-08-30T08")),
        ("week", "2026-08-30T16", ("2026-08-23T16", "2026-08-24T08")),
        ("rolling7", "2026-08-24T08", ("2026-08-17T08", "2026-08-24T08")),
        ("month", "2026-07-31T16", ("2026-06-30T16", "2026-07-31T08")),
        ("weeks12", "2026-06-14T16", ("2026-03-22T16", "2026-06-14T16")),
        ("months12", "2025-08-31T16", ("2024-08-31T16", "2025-08-31T16")),
    ],
)
def test_periods(label, start, compare):
    p = time.resolve_period(label, None, NOW)
    assert [x.strftime("%Y-%m-%dT%H") for x in (p.start, p.compare_start, p.compare_end)] == [start, *compare]


def test_open_and_unknown_periods():
    assert time.resolve_period("lifetime", "UTC", NOW).start is None
    p = time.resolve_period("nonsense", "No/Where", NOW)
    assert p.start is None and p.compare_start is None and p.zone == "Asia/Shanghai"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "expected"), [("/a/./b//c", "/a/b/c"), ("/a/../../b", "/b"), ("../x", "../x"), ("a/../..", ".."), ("/", "/"), ("", "")]
)
def test_normal_path(spark, path, expected):
    assert one(spark, text.normal_path(F.lit(path))) == expected


@pytest.mark.parametrize(
    ("title", "private"),
    [
        ("plan the release", False), ("mail me at a.b@example.com", True), ("see /Users/x", True), ("use 10.0.0.7 now", True), ("use 11.0.0.7 now", False),
        ("key sk-abcdefghijklmnopqrstuvwx", True), ("fcntl and fdisk", False), ("id 0123456789abcdef0123456789abcdef", True), ("fe80::1 is local", True),
    ],
)
def test_private_titles(spark, title, private):
    assert one(spark, text.private(F.lit(title))) is private


def test_uuid_and_fields(spark):
    assert one(spark, time.uuid7_millis(F.lit("018cc251-f400-7000-8000-000000000000"))) == 0x018CC251F400
    assert one(spark, time.uuid7_millis(F.lit("xyz"))) is None
    assert one(spark, text.field_after(F.lit('a model=x model="gpt" }'), "model=")) == "gpt"
    assert one(spark, text.field_after(F.lit("nothing"), "model=")) is None


def test_statuses(spark):
    assert [one(spark, tokens.status(F.lit(x))) for x in (90, 72, 71.9)] == ["critical", "warning", "normal"]
    assert [one(spark, tokens.window_kind(F.lit(x))) for x in (604800, 3600, 200000)] == ["weekly", "short", "custom"]


def test_zone_days_follow_summer_time(spark):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    assert one(spark, time.zone_day(at("2026-08-01 15:30:00"), "Asia/Shanghai")) == "2026-08-01"
    assert one(spark, time.zone_day(at("2026-08-01 16:30:00"), "Asia/Shanghai")) == "2026-08-02"
    assert one(spark, time.zone_hour(at("2026-07-01 03:30:00"), "America/New_York")) == "2026-06-30T23:00"


def test_staleness_and_saturation(spark):
    assert [one(spark, tokens.official_freshness(F.lit(x))) for x in (900, 901)] == ["fresh", "stale"]
    assert [one(spark, tokens.quota_stale(F.lit(x))) for x in (600, 601)] == [False, True]
    assert [one(spark, tokens.freshness(F.lit(x))) for x in (120, 600, 601)] == ["fresh", "delayed", "stale"]
    most = F.lit(tokens.MOST)
    assert one(spark, tokens.saturating_add(most, most)) == tokens.MOST and one(spark, tokens.saturating_add(F.lit(2), F.lit(3))) == 5
    assert one(spark, tokens.saturating_sub(F.lit(2), F.lit(3))) == 0 and one(spark, tokens.saturating_sub(most, F.lit(1))) == tokens.MOST - 1


def test_hours_around_a_time(spark):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    hours = lambda x: [str(one(spark, f(at(x)))) for f in (time.floor_hour, time.ceil_hour)]
    assert hours("2026-08-01 15:30:00") == ["2026-08-01 15:00:00", "2026-08-01 16:00:00"] and hours("2026-08-01 15:00:00") == ["2026-08-01 15:00:00"] * 2


def test_labels(spark):
    assert [one(spark, text.account_label(F.lit(x))) for x in ("12345678", "123456789")] == ["12345678", "12345678…"]
    assert one(spark, text.short_hash(F.lit("a"))) == "ca978112"
    pools = [(" name ", "main", "main", "name"), ("", "main", "main", "main"), (None, "x", "additional:id:x", "x"), (None, None, "additional:0", "additional")]
    for name, limit, key, label in pools:
        assert one(spark, payload.quota_label(F.lit(name).cast("string"), F.lit(limit).cast("string"), F.lit(key))) == label


def test_a_list_that_is_null_is_empty(spark):
    rows = spark.createDataFrame([(None,), ([],), (["a"],)], "x array<string>")
    assert [r.x for r in rows.select(payload.listed(F.col("x")).alias("x")).collect()] == [[], [], ["a"]]
