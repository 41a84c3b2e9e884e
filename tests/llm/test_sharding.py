from __future__ import annotations

import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from meterline.llm import sharding

from .fixtures import ROWS, clashing, documents, sample

COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def rows(collected):
    return sorted((tuple(r[c] for c in COLUMNS) for r in collected), key=str)


def test_equals_its_sql(spark, data):
    docs = sample(spark, data)
    frame = docs.toPandas()  # noqa: F841
    want = duckdb.sql(sharding.SQL.format(documents="frame")).df().to_dict("records")
    assert rows(sharding.shards(docs.repartition(5)).collect()) == rows(want)


def where(spark, tree, n=20_000):
    return [r.s for r in spark.range(n).select(sharding.descend(tree, F.col("id").cast("string")).alias("s")).collect()]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 11])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    before = sharding.balanced(n)
    after = sharding.grown(before, n)
    again = sharding.grown(after, n + 1)
    for old, new, added in ((before, after, n), (after, again, n + 1)):
        a, b = where(spark, old), where(spark, new)
        assert {y for x, y in zip(a, b) if x != y} == {added}
        assert abs(b.count(added) / len(b) - 1 / (added + 1)) < 0.02


def test_shares_follow_the_weights(spark):
    tree = {"a": {"x": {0: 1.0, 1: 3.0}, "y": {2: 2.0}}, "b": {"z": {3: 2.0, 4: 0.0}}}
    got = where(spark, tree)
    assert [round(got.count(i) / len(got) * 8, 1) for i in range(5)] == pytest.approx([1, 3, 2, 2, 0], abs=0.15)


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    tree = sharding.balanced(16, 2, 4)
    of = {s: (region, rack) for region, racks in tree.items() for rack, own in racks.items() for s in own}
    heavier = {**tree, "region0": {**tree["region0"], "rack1": {**tree["region0"]["rack1"], 2: 2.0}}}
    moved = {(x, y) for x, y in zip(where(spark, tree), where(spark, heavier)) if x != y}
    assert moved
    for x, y in moved:
        assert of[y][0] == "region0"  # the other region takes nothing
        if of[x][0] == "region0":  # within the region only the heavier rack takes, within that only the heavier shard
            assert of[y][1] == "rack1"
            if of[x] == ("region0", "rack1"):
                assert y == 2


def test_odd_documents(spark):
    docs = clashing(documents(spark))
    got = sharding.shards(docs).collect()
    assert len(got) == len(ROWS)
    crcs = sorted((r[1] or "").encode() for r in ROWS)
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len(t) + 1, zlib.crc32(t)) for t in crcs)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(x) == 1 for x in by_id.values())
    assert sharding.shards(docs.limit(0)).count() == 0


def test_slots_of_one_id_that_holds_most_rows(spark):
    docs = documents(spark, [(7, f"text {i % 3}", None, None, 0) for i in range(500)] + [(i, "x", None, None, 0) for i in range(100)]).repartition(4)
    slots = defaultdict(list)
    for r in sharding.shards(docs).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == 600


def test_written_shards_hold_all_rows(spark, data, tmp_path):
    docs = sample(spark, data)
    sharding.write(docs, sharding.balanced(), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = {r.doc_id: r.shard for r in sharding.shards(docs).collect()}
    assert got.count() == docs.count() and {r.doc_id: r._shard for r in got.collect()} == want


def test_nothing_but_columns_of_the_jvm(spark, data):
    plan = sharding.sharded(sample(spark, data), sharding.balanced())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
