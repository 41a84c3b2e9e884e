"""The pipeline stage by stage: what each keeps follows from its operator on what the one before it kept."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from meterline.llm import decontaminate, language_id, mixing, queries, quality, simhash
from meterline.llm.common import settle

from .fixtures import clashing, documents


def told(docs) -> set[int]:
    """Documents whose language can be told, by their scores, bytes and lengths."""
    net, kept = language_id.train(docs), set()
    chance, familiar = 1 / len(net.languages), set(np.flatnonzero(net.familiar).tolist())
    for r in language_id.languages(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        own = (r.text or "").encode()
        if r.lang_pred != "und" and r.score * sum(b in familiar for b in own) / len(own) >= chance + (1 - chance) * 0.3 * len(own) / (len(own) + 200):
            kept.add(r.doc_id)
    return kept


def test_stages_in_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    benchmark, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("benchmark", "labels"))
    expect = {
        "quality": lambda d: {r.doc_id for r in quality.quality(d, labels).collect() if r.predicted == 1},
        "language_id": told,
        "near_dedup": lambda d: {r.doc_id for r in simhash.simhash_components(d).collect() if r.doc_id == r.component_id},
        "decontamination": lambda d: {r.doc_id for r in d.select("doc_id").collect()} - {r.doc_id for r in decontaminate.overlaps(d, benchmark).collect()},
        "mixing": lambda d: {r.doc_id for r in mixing.mix(d).collect() if r.taken},
    }
    assert [name for name, _ in corpus_pipeline.STAGES] == list(expect)
    for name, stage in corpus_pipeline.STAGES:
        kept = settle(stage(spark, docs, data))
        assert {r.doc_id for r in kept.collect()} == expect[name](docs), name
        if name != "mixing":
            assert kept.columns == docs.columns
        docs = kept
    assert 0 < docs.count() < 200
    assert {tuple(r) for r in docs.collect()} == {tuple(r) for r in corpus_pipeline.run(spark, data).collect()}


def test_stages_with_odd_documents(spark, data):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (clashing(documents(spark)), documents(spark).limit(0)):
            kept = stage(spark, docs, data)
            assert name == "mixing" or kept.columns == docs.columns
            assert kept.count() <= 10


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_run(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() >= 0
