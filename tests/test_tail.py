"""Logs read by byte ranges, state carried over any cut, and commits that are whole or absent."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterline.sources import tail as source
from meterline.sources.logs import records, written_files
from meterline.streaming import ingest, machines
from meterline.streaming.store import Store, append, exists

from .test_machines import START, count, lines_of, record, uuid

NOW = START + timedelta(hours=1)


def lines(path, at=0, last=None, length=None, newest=None):
    length = path.stat().st_size if length is None else length
    got = source.lines_of(source.Range("f", str(path), at, length if last is None else last, length), newest).to_pylist()
    return [(r["place"], r["line"]) for r in got[:-1]], got[-1]["place"], got[-1]["stopped"], got[-1]["bytes"]


@pytest.mark.parametrize("seed", range(30))
def test_ranges_have_each_line_once(tmp_path, monkeypatch, seed):
    draw = random.Random(seed)
    monkeypatch.setattr(source, "STEP", draw.choice([1, 3, 1 << 20]))
    data = b"".join(draw.choice([b"a", b"bb", b"\n", b"\r\n", b"ccc\n", "é".encode()]) for _ in range(draw.randrange(60)))
    path = tmp_path / "x"
    path.write_bytes(data)
    expected, at = [], 0
    for line in data.split(b"\n")[:-1]:
        if line.strip(b"\r"):
            expected.append((at, line.removesuffix(b"\r").decode(errors="replace")))
        at += len(line) + 1
    size = draw.randrange(1, 20)
    got, places, stopped = [], [], []
    for r in source.ranges([("f", str(path), 0, len(data))], size):
        own, place, stop, _ = lines(path, r.first, r.last)
        got += own
        places.append(place)
        stopped += [place] if stop else []
    assert got == expected
    if data:
        assert (min(stopped) if stopped else max(places)) == data.rfind(b"\n") + 1


def test_reading_stops_at_lines_newer_than_the_watermark_and_goes_on_there(tmp_path):
    path, own = tmp_path / "x", [record(s, "turn_context", model=f"m{s}") for s in range(10)]
    path.write_text("\n".join([*own, "{unfinished"]))
    got, place, stopped, _ = lines(path, newest=START + timedelta(seconds=4.5))
    assert [x for _, x in got] == own[:5] and stopped and place == sum(len(x) + 1 for x in own[:5])
    got, place, stopped, read = lines(path, at=place)
    assert [x for _, x in got] == own[5:] and stopped and read <= len("\n".join([*own[5:], "{unfinished"])) + 1
    assert place == path.stat().st_size - len("{unfinished")


def test_times_that_cannot_be_read_are_not_newer():
    newest = datetime.fromisoformat("2026-01-01T00:00:00+00:00")
    times = {"2026-01-01T00:00:00Z": False, "2026-01-01T00:00:00.000001Z": True, "2026-01-01T01:00:00+02:00": False, "x": False, "2026-01-01T00:00:01": True, "": False}
    assert {t: source.newer(b'{"timestamp":"' + t.encode() + b'"}', newest) for t in times} == times
    assert not source.newer(b"{}", newest)


def test_usage_candidates_are_possible_counts_with_a_time(spark):
    good = count(1, 10, 10).replace(": ", ":")
    rows = [good, good.replace('"input_tokens":5', '"input_tokens":6'), good.replace("token_count", "token_counts"), good.replace("timestamp", "stamp"), count(1, 10).replace(": ", ":"), '{"type":"token_count"', good.replace('"total_tokens":10', '"total_tokens":"10"')]
    got = source.candidates(spark.createDataFrame(list(enumerate(rows)), "line_no long, line string").withColumn("source", F.lit("f"))).collect()
    assert [(r.line_no, r.total, r.input) for r in got] == [(0, 10, 5)]


def session(seed: int, n: int = 40) -> list[str]:
    """Records of a file with foreign history, contexts, repeated and falling counters, and lines of no kind."""
    draw, at, total, out = random.Random(seed), 100.0, 0, []
    child, parent = uuid(100), uuid(0)
    for _ in range(n):
        at += draw.choice([0.1, 0.5, 3])
        total = draw.choice([total, total + 10, total + 25, max(total - 40, 10)])
        last = draw.choice([None, total and max(total, 6), draw.randrange(6, 30)])
        out.append(draw.choice([
            count(at, max(total, 6), last), count(at, max(total, 6), last), count(at, None, 7),
            record(at, "turn_context", model=draw.choice(["a", "b", ""]), cwd=draw.choice(["/x", "/y"])),
            record(at, "session_meta", id=draw.choice([child, parent]), cwd="/own"),
            record(at, "task_started", turn_id=draw.choice([uuid(1), uuid(at)])),
            "{broken", '{"type":"other"}',
        ]))
    return [*draw.choice([[], [count(99, 50, 50)]]), record(100, "session_meta", id=child, cwd="/c", source={"subagent": {"thread_spawn": {"parent_thread_id": parent}}}), *out]


def plain(rows, *without):
    return sorted([str(v) for k, v in sorted(r.asDict().items()) if k not in without] for r in rows)


def test_any_cut_of_a_file_gives_the_same_facts(spark):
    files = {f"f{i}": session(i) for i in range(8)}
    whole = records(lines_of(spark, files))
    targets = spark.createDataFrame([(f, uuid(100), uuid(0) if i % 2 else None) for i, f in enumerate(files)], "source string, thread_id string, parent_thread_id string")
    for machine, expected in ((ingest.GUARD, machines.guarded(whole)), (ingest.rebuilding(targets), machines.reconstructed(whole, targets))):
        expected = plain(expected.collect())
        assert len(expected) > 40
        for cuts in ([10], [1, 2, 20, 30], list(range(0, 42, 6))):
            state, got = None, []
            for lo, hi in zip([-1, *cuts], [*cuts, 10**6]):
                walked = machine.walk(whole.where(f"line_no > {lo} and line_no <= {hi}"), state)
                got += machine.facts(walked).collect()
                new = machine.state(walked)
                old = [] if state is None else [r for r in state.collect()]
                fresh = new.collect()
                seen = {r.source for r in fresh}
                state = spark.createDataFrame([*fresh, *[r for r in old if r.source not in seen]], machine.schema)
            assert plain(got) == expected, cuts


def folder(spark, tmp_path, name="store"):
    logs = tmp_path / "in"
    logs.mkdir(exist_ok=True)
    return logs, Store(spark, str(tmp_path / name))


def totals(store):
    rows = store.facts()
    return sorted(r.total for r in rows.collect()) if rows is not None else []


def test_only_new_bytes_of_growing_files_are_read(spark, tmp_path):
    logs, store = folder(spark, tmp_path)
    file, own = logs / "rollout-a {1}.jsonl", session(3, 60)
    expected = plain(machines.guarded(records(lines_of(spark, {"f": own}))).collect(), "line_no", "source")
    data, at = ("\n".join(own) + "\n").encode(), 0
    for cut in (1000, 1001, 5000, 5600, len(data)):
        with file.open("ab") as f:
            f.write(data[at:cut])
        at = cut
        assert ingest.tail(store, written_files(spark, str(logs)), NOW, range_bytes=700) == 1
        place = store.sources().first()
        assert place["next"] == data[:at].rfind(b"\n") + 1
    assert ingest.tail_folder(store, str(logs), NOW) == 0
    assert plain(store.facts().drop("event_id", "hash", "generation", "local_day", "commit", "source", "line_no").collect()) == expected
    read = [r.bytes for r in store.part("sources").orderBy("commit").collect()]
    ends = [data[:cut].rfind(b"\n") + 1 for cut in (0, 1000, 1001, 5000, 5600, len(data))]
    for n, (lo, hi) in zip(read, zip(ends, (1000, 1001, 5000, 5600, len(data)))):
        assert hi - lo <= n <= (hi - lo) + ((hi - lo) // 700 + 1) * 513 + 1  # and a line's end beyond each range


def test_lines_of_the_last_seconds_wait(spark, tmp_path):
    logs, store = folder(spark, tmp_path)
    (logs / "rollout-a.jsonl").write_text("\n".join([record(0, "session_meta", id="s"), count(1, 10, 10), count(58, 30, 20)]) + "\n")
    for seconds, expected in ((60, [10]), (62, [10]), (63, [10, 20])):
        ingest.tail_folder(store, str(logs), START + timedelta(seconds=seconds))
        assert totals(store) == expected


@pytest.mark.parametrize("broken_at", ["facts", "sources", "commit"])
def test_broken_runs_leave_nothing_and_are_repeated(spark, tmp_path, monkeypatch, broken_at):
    logs, store = folder(spark, tmp_path)
    file = logs / "rollout-a.jsonl"
    file.write_text(record(0, "session_meta", id="s") + "\n" + count(1, 10, 10) + "\n")
    ingest.tail_folder(store, str(logs), NOW)
    with file.open("a") as f:
        f.write(count(2, 30, 20) + "\n")
    before = store.sources().collect()

    def stop(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if broken_at == "commit":
            m.setattr(Store, "_publish", stop)
        else:
            write = Store.commit
            m.setattr(Store, "commit", lambda self, parts: write(self, {**{k: v for k, v in parts.items() if k != broken_at}, broken_at: parts[broken_at].where(F.raise_error(F.lit("lost")).cast("boolean"))}))
        with pytest.raises(Exception, match="lost"):
            ingest.tail_folder(store, str(logs), NOW)
    assert totals(store) == [10] and store.sources().collect() == before
    assert ingest.tail_folder(store, str(logs), NOW) == 1 and totals(store) == [10, 20]
    assert ingest.tail_folder(store, str(logs), NOW) == 0
    assert store.vacuum() == 1 and totals(store) == [10, 20]


def test_a_replaced_file_leaves_no_fact_of_its_old_self(spark, tmp_path):
    logs, store = folder(spark, tmp_path)
    file, other = logs / "rollout-a.jsonl", logs / "rollout-b.jsonl"
    old = (START - timedelta(days=9) - START).total_seconds()
    file.write_text("\n".join([record(0, "session_meta", id="s"), count(old, 7, 7), count(1, 10, 10), count(2, 30, 20)]) + "\n")
    other.write_text(record(0, "session_meta", id="t") + "\n" + count(1, 6, 6) + "\n")
    ingest.tail_folder(store, str(logs), NOW)
    sums = lambda: sorted(r.total for r in store.days().collect())
    assert (totals(store), sums(), store.keys().count()) == ([6, 10, 20], [6, 7, 30], 1)
    file.write_text(record(0, "session_meta", id="s") + "\n" + count(9, 70, 70) + "\n")  # shorter
    assert ingest.tail_folder(store, str(logs), NOW) == 1
    assert (totals(store), sums(), store.keys().count()) == ([6, 70], [6, 70], 0)
    with file.open("a") as f:
        f.write(count(10, 78, 8) + "\n")
    ingest.tail_folder(store, str(logs), NOW)
    assert totals(store) == [6, 8, 70]
    files = written_files(spark, str(logs)).withColumn("identity", F.concat("identity", F.lit("#2")))  # as long, but another file
    assert ingest.tail(store, files, NOW) == 2 and totals(store) == [6, 8, 70]
    assert sorted(r.generation for r in store.sources().collect()) == [1, 2]
    store.compact()
    assert totals(store) == [6, 8, 70] and len(store.commits()) == 1
    assert store.vacuum() == 4 and totals(store) == [6, 8, 70] and ingest.tail(store, files, NOW) == 0


def test_of_files_never_seen_only_the_end_is_read_if_asked(spark, tmp_path):
    logs, store = folder(spark, tmp_path)
    own = [record(0, "session_meta", id="s"), *[count(i, 10 * i, 10) for i in range(1, 9)]]
    (logs / "rollout-a.jsonl").write_text("\n".join(own) + "\n")
    ingest.tail(store, written_files(spark, str(logs)), NOW, bootstrap=len(own[-1]) * 2 + 10)
    assert [(r.total, r.quality) for r in store.facts().collect()] == [(10, "quarantined")] * 2


def test_reconstruction_is_replaced_too(spark, tmp_path):
    logs, store = folder(spark, tmp_path)
    file = logs / "rollout-a.jsonl"
    file.write_text("\n".join([record(0, "session_meta", id="s"), count(1, 100), count(2, 150)]) + "\n")
    name = written_files(spark, str(logs)).first().source
    machine = ingest.rebuilding(spark.createDataFrame([(name, "s", None)], "source string, thread_id string, parent_thread_id string"))
    ingest.tail_folder(store, str(logs), NOW, machine)
    with file.open("a") as f:
        f.write(count(3, 190) + "\n")
    ingest.tail_folder(store, str(logs), NOW, machine)
    assert totals(store) == [40, 50, 100]
    file.write_text(record(0, "session_meta", id="s") + "\n" + count(1, 9) + "\n")
    ingest.tail_folder(store, str(logs), NOW, machine)
    assert totals(store) == [9]


FACT = "event_id string, at timestamp, local_day string, thread_id string, model string, quality string, input long, cached_input long, cache_write_input long, cache_write_observed long, output long, reasoning_output long, total long"


def delivered(spark, *rows):
    make = lambda id_, days, total: (id_, NOW - timedelta(days=days), str((NOW - timedelta(days=days)).date()), "t", "m", "confirmed", total, 0, 0, 0, 0, 0, total)
    return spark.createDataFrame([make(*r) for r in rows], FACT)


def test_late_facts_count_once_by_key_and_day_sums(spark, tmp_path):
    _, store = folder(spark, tmp_path)
    append(store, delivered(spark, ("aa", 1, 10), ("bb", 8, 20)), NOW)
    sums = lambda: sorted((r.local_day, r.total) for r in store.days().collect())
    expected = sums()
    assert totals(store) == [10] and [r.event_id for r in store.keys().collect()] == ["bb"] and sorted(t for _, t in expected) == [10, 20]
    append(store, delivered(spark, ("aa", 1, 10), ("bb", 8, 20), ("bb", 8, 20)), NOW)
    assert sums() == expected and totals(store) == [10] and store.keys().count() == 1
    append(store, delivered(spark, ("cc", 30, 5)), NOW)
    assert sorted(t for _, t in sums()) == [5, 10, 20]


def test_a_changed_replay_stops_the_load(spark, tmp_path):
    _, store = folder(spark, tmp_path)
    append(store, delivered(spark, ("aa", 1, 10), ("bb", 8, 20)), NOW)
    before = (totals(store), store.commits())
    with pytest.raises(Exception, match="other content than before: bb"):
        append(store, delivered(spark, ("new", 1, 1), ("bb", 9, 21)), NOW)
    assert (totals(store), store.commits()) == before


def test_a_changed_recent_fact_counts_as_it_came_last(spark, tmp_path):
    _, store = folder(spark, tmp_path)
    append(store, delivered(spark, ("aa", 1, 10), ("bb", 2, 20)), NOW)
    append(store, delivered(spark, ("aa", 1, 11)), NOW)
    append(store, delivered(spark, ("aa", 1, 12), ("bb", 2, 20)), NOW)
    assert totals(store) == [12, 20] and sorted(r.total for r in store.days().collect()) == [12, 20]
    store.compact(NOW + timedelta(days=6))  # what has aged by then becomes keys and sums
    assert totals(store) == [12] and sorted(r.total for r in store.days().collect()) == [12, 20] and store.keys().count() == 1
    with pytest.raises(Exception, match="other content"):
        append(store, delivered(spark, ("bb", 2, 1)), NOW + timedelta(days=6))


def test_of_two_writers_at_once_the_second_fails(spark, tmp_path, monkeypatch):
    _, store = folder(spark, tmp_path)
    append(store, delivered(spark, ("aa", 1, 10)), NOW)
    stale = store.commits()
    other = Store(spark, store.root)
    monkeypatch.setattr(other, "commits", lambda: stale)
    append(store, delivered(spark, ("bb", 1, 20)), NOW)
    with pytest.raises(Exception, match="already exists"):
        append(other, delivered(spark, ("cc", 1, 30)), NOW)
    assert totals(store) == [10, 20]


def test_nothing_stored_yet(spark, tmp_path):
    logs, store = folder(spark, tmp_path)
    assert store.facts() is None and store.days() is None and store.sources() is None and store.keys().count() == 0 and store.commits() == []
    (logs / "rollout-a.jsonl").write_text("")
    assert ingest.tail_folder(store, str(logs), NOW) == 0 and not exists(spark, f"{store.root}/commits")


def test_a_stream_of_facts_counts_each_key_once_and_late_ones_within_their_time(spark, tmp_path):
    facts = tmp_path / "facts"
    make = lambda *rows: spark.createDataFrame([(i, START.replace(tzinfo=None) + timedelta(hours=h), "t", "m", n, 0, 0, 0, 0, 0, n) for i, h, n in rows], "event_id long, source_timestamp timestamp, thread_id string, model string, input long, cached_input long, cache_write_input long, cache_write_observed long, output long, reasoning_output long, total long")
    schema = make().schema

    def run(*rows):
        make(*rows).write.mode("append").parquet(str(facts))
        stream = ingest.hourly(spark.readStream.schema(schema).parquet(str(facts)))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.hour.start.hour, r.event_count, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    run((1, 0.1, 5), (1, 0.1, 5), (2, 0.5, 7), (3, 1.5, 1))
    run((2, 0.5, 7), (4, 0.2, 100), (5, 24 * 7 + 5, 0))  # a repetition and a late one; then time goes on
    assert run((6, 24 * 7 + 6, 0), (7, 0.3, 1000))[:2] == [(0, 3, 112), (1, 1, 1)]  # what comes after its time isn't counted
