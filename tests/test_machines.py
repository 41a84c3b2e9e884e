"""Replay guard, reconstruction and matcher on small logs, and against step-by-step versions."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime, timedelta

import pytest

from meterline.sources.logs import read_lines, records
from meterline.streaming import machines
from meterline.streaming.ingest import ingest

START = datetime(2026, 1, 1, tzinfo=UTC)


def uuid(seconds: float) -> str:
    h = f"{int((START + timedelta(seconds=seconds)).timestamp() * 1000):012x}"
    return f"{h[:8]}-{h[8:]}-7000-8000-000000000000"


def record(seconds: float, kind: str, **payload) -> str:
    outer = kind if kind in ("session_meta", "turn_context") else "event_msg"
    if outer == "event_msg":
        payload["type"] = kind
    return json.dumps({"type": outer, "timestamp": (START + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "payload": payload})


def usage(total: int, reasoning: int = 0) -> dict:
    return {"input_tokens": total - 5, "cached_input_tokens": 1, "output_tokens": 5, "reasoning_output_tokens": reasoning, "total_tokens": total}


def count(seconds: float, total: int | None = None, last: dict | int | None = None) -> str:
    last = usage(last) if isinstance(last, int) else last
    info = {k: v for k, v in (("total_token_usage", usage(total) if total else None), ("last_token_usage", last)) if v}
    return record(seconds, "token_count", info=info)


def lines_of(spark, files: dict[str, list[str]]):
    return spark.createDataFrame([(s, i, x) for s, own in files.items() for i, x in enumerate(own)], "source string, line_no long, line string")


def facts(spark, *own: str):
    return [r.asDict() for r in machines.guarded(records(lines_of(spark, {"f": list(own)}))).orderBy("line_no").collect()]


def test_foreign_history_is_quarantined(spark):
    child, parent = uuid(100), uuid(0)
    got = facts(
        spark,
        record(100, "session_meta", id=child, cwd="/child", source={"subagent": {"thread_spawn": {"parent_thread_id": parent}}}),
        record(0, "session_meta", id=parent, cwd="/parent"),
        record(1, "task_started", turn_id=uuid(1), started_at=1),
        record(1, "turn_context", model="parent-model", cwd="/parent"),
        count(2, 1000, 1000),
        record(3, "task_started", turn_id=uuid(3)),
        record(101, "task_started", turn_id=uuid(101)),
        record(101, "turn_context", model="child-model"),
        count(102, None, 105),
    )
    assert [(f["quality"], f["total"]) for f in got] == [("quarantined", 1000), ("confirmed", 105)]
    assert (got[1]["thread_id"], got[1]["parent_id"], got[1]["model"], got[1]["cwd"]) == (child, parent, "child-model", "/child")
    assert got[0]["reason"] == "foreign_history"


def test_counter_epochs(spark):
    got = facts(spark, record(0, "session_meta", id="s"), count(1, 10, 10), count(2, 10, 10), count(3, 18, 8), count(4, 3 + 5, 8), count(5, 8, 8))
    assert [(f["total"], f["quality"], f["counter_epoch"]) for f in got] == [(10, "confirmed", 0), (8, "confirmed", 0), (8, "confirmed", 1)]


def test_missing_and_impossible_last_usage(spark):
    got = facts(spark, record(0, "session_meta", id="s"), count(1, 10), count(2, 30, usage(20, reasoning=9)))
    assert [(f["quality"], f["reason"], f["total"]) for f in got] == [("quarantined", "last_usage_missing", 10), ("quarantined", "last_usage_invalid", 20)]


def test_counts_before_a_session_and_broken_lines(spark):
    got = facts(spark, "{broken", count(1, 10, 10), record(2, "session_meta", id="s"), count(3, 10, 10))
    assert [(f["quality"], f["reason"]) for f in got] == [("quarantined", "before_session"), ("confirmed", None)]


def test_lenient_usage(spark):
    info = {"last_token_usage": {"input_tokens": "30", "cache_write_tokens": 10, "output_tokens": 2}}
    got = facts(spark, record(0, "session_meta", id="s"), record(1, "token_count", info=info))
    assert (got[0]["input"], got[0]["cache_write_input"], got[0]["cache_write_observed"], got[0]["total"]) == (30, 10, 30, 32)


def rebuilt(spark, parent: str | None, *own: str):
    targets = spark.createDataFrame([("f", "s", parent)], "source string, thread_id string, parent_thread_id string")
    return [r.total for r in machines.reconstructed(records(lines_of(spark, {"f": list(own)})), targets).orderBy("line_no").collect()]


def test_inherited_prefix_sets_the_baseline(spark):
    own = (record(0, "session_meta", id="s"), count(0.1, 100), count(0.2, 200), count(3, 250))
    assert rebuilt(spark, "p", *own) == [50]
    assert rebuilt(spark, None, *own) == [100, 100, 50]


def test_root_counts_in_full(spark):
    zero_output = lambda t: {"input_tokens": t, "output_tokens": 0, "total_tokens": t}
    c = lambda s, t, last=None: record(s, "token_count", info={k: v for k, v in (("total_token_usage", zero_output(t)), ("last_token_usage", last and zero_output(last))) if v})
    meta = record(0, "session_meta", id="s")
    assert rebuilt(spark, None, meta, c(1, 100), c(2, 150), c(3, 150), c(9, 200)) == [100, 50, 50]
    assert rebuilt(spark, None, meta, c(1, 100), c(2, 30), c(3, 40)) == [100, 10]  # a reset without last usage
    assert rebuilt(spark, None, meta, c(1, 100), c(2, 30, 30)) == [100, 30]
    assert rebuilt(spark, "p", meta, c(0.1, 100), c(0.2, 200), c(3, 250)) == [50]
    assert rebuilt(spark, "p", meta, c(5, 100)) == [100]  # the first reading comes too late to be inherited
    assert rebuilt(spark, None, record(0, "session_meta", id="other"), c(1, 100)) == []


def greedy(observations, candidates, tolerance):
    used, out = set(), {}
    for own, at in observations:
        best = None
        for i, (c, when) in enumerate(candidates):
            gap = abs(when - at)
            if i not in used and gap <= tolerance and (best is None or gap < best[0]):
                best = (gap, i)
        if best:
            used.add(best[1])
        out[own] = candidates[best[1]][0] if best else None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matcher_equals_the_step_by_step_rule(spark, seed):
    import random

    r = random.Random(seed)
    base = START.replace(tzinfo=None)
    rows = {k: sorted((r.randrange(4000), i) for i in range(60)) for k in ("o", "c")}
    frame = lambda k: spark.createDataFrame([("t", i, base + timedelta(milliseconds=ms)) for ms, i in rows[k]], "thread_id string, id long, at timestamp_ntz")
    got = {x.observation_id: x.candidate_id for x in machines.matched(frame("o"), frame("c"), 100_000).collect()}
    assert got == greedy([(i, ms) for ms, i in rows["o"]], [(i, ms) for ms, i in rows["c"]], 100)


def test_files_are_read_with_their_place_and_ingested_once(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    own = [record(0, "session_meta", id="s"), count(1, 10, 10), count(2, 30, 20)]
    (logs / "rollout-a.jsonl").write_text("\r\n".join(own) + "\n" + "{unfinished")
    assert read_lines(spark, str(logs)).count() == 3
    from meterline.sources.logs import stream_lines

    for _ in range(2):
        ingest(stream_lines(spark, str(logs)), str(tmp_path / "facts"), str(tmp_path / "checkpoint")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "facts"))
    assert sorted(r.total for r in stored.collect()) == [10, 20]
    ingest(stream_lines(spark, str(logs)), str(tmp_path / "facts"), str(tmp_path / "checkpoint2")).awaitTermination()  # delivered again
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 2


def test_stream_leaves_unfinished_lines(spark, tmp_path):
    from meterline.sources.logs import stream_lines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rollout-a.jsonl").write_text(record(0, "session_meta", id="s") + "\n" + count(1, 10, 10))  # whole, but no end yet
    ingest(stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "facts"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.schema("total long").parquet(str(tmp_path / "facts")).count() == 0


def test_the_guard_sorts_records_once_and_deals_files_over_all_partitions(spark, data):
    from meterline.plans.catalogue import _records
    from meterline.plans.ledger import Ledger
    from meterline.operators.checkpoint import settle

    records = settle(_records(Ledger(spark, data)))
    facts = machines.guarded(records)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(re.findall(r"\bSort \[source", plan)) == 1 and "hashpartitioning(source" in plan and facts.rdd.getNumPartitions() == parts
