"""Quota payloads, secrets, fingerprints; discovery of files."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from meterline.functions import payload
from meterline.sources import discovery


def pools(spark, value) -> dict:
    rows = payload.quota_windows(spark.createDataFrame([(json.dumps(value),)], "payload string")).collect()
    return {(r.pool_key, r.window_name): (r.used_percent, r.window_seconds, r.resets_at, r.warning) for r in rows}


def test_account_response(spark):
    limit = lambda used: {"allowed": True, "primary_window": {"used_percent": used, "limit_window_seconds": 18000, "reset_at": 7}, "secondary_window": None}
    got = pools(spark, {"rate_limit": limit(12), "additional_rate_limits": [{"limit_name": "x", "rate_limit": limit(3)}, {"rate_limit": limit(125)}], "code_review_rate_limit": limit(0), "credits": {"balance": "12.50"}})
    w = "primary_window"
    assert got == {("main", w): (12.0, 18000, 7, None), ("x", w): (3.0, 18000, 7, None), ("additional-1", w): (None, 18000, 7, "used_percent_out_of_range"), ("code_review", w): (0.0, 18000, 7, None)}


def test_event_with_windows_of_any_name(spark):
    got = pools(spark, {"limit_id": "main-id", "primary": {"used_percent": 1.5, "window_minutes": 300, "resets_at": 9}, "yearly": {"used_percent": 2, "window_minutes": 525600}, "note": "none"})
    assert got == {("main-id", "primary"): (1.5, 18000, 9, None), ("main-id", "yearly"): (2.0, 31536000, None, None)}


def test_secrets_are_removed_at_any_depth(spark):
    value = {"cap": 1, "auth_token": "x", "a": [{"Email": "x", "deep": {"api_key": 1, "keep": [1, {"org_id": 2}]}}]}
    frame = spark.createDataFrame([(json.dumps(value),), ("no json",), (None,)], "p string")
    got = [r.x and json.loads(r.x) for r in frame.select(payload.sanitized("p").alias("x")).collect()]
    assert got == [{"cap": 1, "a": [{"deep": {"keep": [1, {}]}}]}, None, None]


def test_fingerprint_equals_the_library(spark):
    for key in (b"k", b"long" * 40):
        got = spark.createDataFrame([("ä@b",)], "v string").select(payload.fingerprint(F.col("v"), key, "account").alias("x")).first().x
        message = b"".join(len(p).to_bytes(8, "big") + p for p in (b"account", "ä@b".encode()))
        assert got.lower() == hmac.new(key, message, hashlib.sha256).hexdigest()


def test_pending_files(spark):
    files = spark.createDataFrame([("a", "1", 10), ("b", "2", 10), ("c", "1", 10), ("d", "9", 0), ("e", "3", 5)], "source string, identity string, length long")
    cursors = spark.createDataFrame([("a", "1", 10), ("x", "2", 4), ("e", "3", 9)], "source string, identity string, offset long")
    assert {r.source: r.offset for r in discovery.pending(files, cursors).collect()} == {"b": 4, "e": 9}


def test_indexed_files_stay_under_their_root(spark):
    index = spark.createDataFrame([("/a/x.jsonl",), ("/ab/x.jsonl",), ("/a/../b/x.jsonl",), ("/a/y.txt",), ("/a/x.jsonl",)], "path string")
    assert [r.path for r in discovery.indexed_files(index, ["/a/"]).collect()] == ["/a/x.jsonl"]
    assert discovery.indexed_files(index, []).count() == 0
