from __future__ import annotations

import numpy as np
import pytest
import xxhash

from meterline.llm import simhash

from .fixtures import clashing, documents, sample


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids: list[int], fps: list[int]) -> dict[int, int]:
    fp, label = np.array(fps, np.uint64), np.array(ids)
    while True:
        new = np.array([label[np.bitwise_count(fp ^ f) <= 4].min() for f in fp])
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def test_fingerprints_and_components_of_real_documents(spark, data):
    rows = sample(spark, data).collect()
    got = simhash.simhash_components(sample(spark, data)).collect()
    expected = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in expected.items()}
    assert {r.doc_id: r.component_id for r in got} == plain_components(list(expected), list(expected.values()))


@pytest.mark.parametrize("seed", range(3))
def test_links_of_clusters_are_complete(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)  # so that anchors are tiled
    random = np.random.default_rng(seed)
    fps = []
    for centre in random.integers(0, 2**63, 30, dtype=np.uint64):
        for _ in range(random.integers(1, 40)):
            own = int(centre)
            for bit in random.integers(0, 64, random.integers(0, 6)):
                own ^= 1 << int(bit)
            fps.append(own)
    fps = sorted(set(fps))
    ids = [int(x) for x in random.permutation(len(fps))]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    classes = spark.createDataFrame(list(zip(signed, ids)), "fp long, rep long")
    from meterline.llm.common import connected_components

    label = {i: i for i in ids} | {r.node: r.component for r in connected_components(simhash.link(classes)).collect()}
    assert label == plain_components(ids, fps)


def test_every_word_has_an_anchor_within_three():
    nearest, near = simhash.golay()
    assert np.bitwise_count(nearest.astype(np.uint64)).max() == 3
    assert (near >= 0).sum() == sum(__import__("math").comb(23, k) for k in range(5))


def test_rows_repeated_for_a_join_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from meterline.llm.common import met_by

    rows = spark.range(30_000).selectExpr("id as own", "id % 700 as k")
    joined = met_by(rows, rows.groupBy("k").agg(F.max("own").alias("most")), "k", "own")
    got = joined.collect()
    assert len(got) == 30_000 and all(r.most == max(range(r.k, 30_000, 700)) for r in got)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_odd_documents(spark):
    docs = clashing(documents(spark))
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)} <= got
    assert simhash.simhash_components(docs).count() == 10
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, i) for i in (1, 3, 6, 7, 8)]
    assert kept.where("doc_id is null").count() == 1
    assert simhash.simhash_components(docs.limit(0)).count() == 0 == simhash.keep_one(docs.limit(0)).count()


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    from pyspark.sql import functions as F

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, a), (None, c), (None, c), (None, a), (4, b), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp0", F.lit("clash"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (None, c)], key=str)
    got = simhash.simhash_components(docs)
    assert got.select("fingerprint").distinct().count() == 3
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got.collect()) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1)]
