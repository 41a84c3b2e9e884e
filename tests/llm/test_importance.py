from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from meterline.llm import common, importance

from .fixtures import LONG, ROWS, clashing, documents, sample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def brute(rows, target, runs=1, buckets=10_000, share=10, least=20, seed=2024):
    """rows (doc_id, text, ...) in order."""

    def words(text):
        return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def features(text):
        own = words(text)
        return [" ".join(own[i : i + k]) for k in range(1, runs + 1) for i in range(len(own) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (Counter(bucket(f) for text in column for f in features(text)) for column in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, (doc_id, text, *_) in enumerate(rows):
        own = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text)), i])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts,bytes_", [(1, 10 << 20), (5, 20_000)])
@pytest.mark.parametrize("runs", [1, 3])
def test_equals_brute_force_however_cut(spark, data, parts, bytes_, runs, monkeypatch):
    monkeypatch.setattr(importance, "BYTES_AT_ONCE", bytes_)
    docs, target = sample(spark, data), spark.read.parquet(f"{data}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [r.text for r in target.collect()], runs, buckets=500, share=30)
    assert got(importance.resampled(docs.repartition(parts, "doc_id"), target, runs, 500, 30)) == want
    if bytes_ < 1 << 20:
        assert importance.records(docs.selectExpr("doc_id", "text", "doc_id as ref"), 1).count() > 3


def test_equals_its_sql(spark, data):
    docs, target = sample(spark, data), spark.read.parquet(f"{data}/benchmark.parquet")
    documents_, benchmark_ = docs.toPandas(), target.toPandas()  # noqa: F841
    sql = importance.SQL.replace("{documents}", "documents_").replace("{benchmark}", "benchmark_")
    want = sorted(duckdb.sql(f"select {', '.join(COLUMNS)} from ({sql})").fetchall(), key=str)
    assert got(importance.resampled(docs, target)) == want


def test_odd_documents(spark):
    target = documents(spark, [(1, "the long story of HÉLLO", None, None, 0), (2, None, None, None, None)])
    docs = clashing(documents(spark)).coalesce(1)
    want = brute(ROWS, ["the long story of HÉLLO", None], share=100)
    assert got(importance.resampled(docs, target, share=100)) == want
    assert sum(r[4] is not None for r in want) == 1 and len(LONG.split()) in {r[1] for r in want}
    assert importance.resampled(docs.limit(0), target).count() == 0
    assert got(importance.resampled(docs, target.limit(0), share=100)) == brute(ROWS, [], share=100)


def test_ties_and_repeated_rows(spark):
    text = "one two three " * 10
    rows = [(5, text, None, None, 0)] * 40 + [(None, text, None, None, 0)] * 3 + [(i, text, None, None, 0) for i in range(100, 140)]
    docs = documents(spark, rows).coalesce(1)
    assert got(importance.resampled(docs, documents(spark, [(1, "one", None, None, 0)]))) == brute(rows, ["one"])


def test_drawn_rows_keep_all_columns(spark, data):
    docs, target = sample(spark, data), spark.read.parquet(f"{data}/benchmark.parquet")
    ids = {r.doc_id for r in importance.resampled(docs, target).where("rank is not null").collect()}
    drawn = importance.drawn(docs, target)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == ids and ids


def test_blocks_hold_no_more_than_they_may():
    texts = ["a" * n for n in (3, 4, 100, 1, 0, 0, 9, 2)] + [None]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 4], pa.string())}) for i in range(0, len(texts), 4)]
    cut = [t.column("text").to_pylist() for t in common.blocks(iter(batches), 10)]
    assert sum(cut, []) == texts and [len(x) for x in cut] == [2, 1, 4, 2]
    assert all(len(x) == 1 or sum(len(t or "") for t in x) <= 10 for x in cut)
