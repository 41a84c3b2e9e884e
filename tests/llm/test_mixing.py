from __future__ import annotations

import duckdb
import pytest

from meterline.llm import mixing

from .fixtures import ROWS, clashing, documents, sample


def rows_of(frame):
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return sorted(((tuple(None if v != v else v for v in r)) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


def by_sql(frame):
    documents = frame  # noqa: F841
    return duckdb.sql(mixing.SQL.format(documents="documents")).df()


def test_equals_sorting(spark, data):
    docs = sample(spark, data)
    assert rows_of(mixing.mix(docs).toPandas()) == rows_of(by_sql(docs.toPandas()))


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 500, "c": 500}, {"a": 1, "b": 1, "c": 900, "d": 40}, {"a": 7}, {"a": 0, "b": 3}])
def test_targets_stop_at_three_times_the_source(spark, sizes):
    rows = [(i, "w " * 1, "en", s, 2) for s, n in sizes.items() for i in range(n)] + [(9000 + i, "", "en", s, 0) for i, s in enumerate(sizes)]
    got = mixing.mix(documents(spark, rows)).toPandas()
    assert rows_of(got) == rows_of(by_sql(documents(spark, rows).toPandas()))
    frame = documents(spark, rows).toPandas().assign(doc=lambda f: f.doc_id)
    assert (got.taken <= 3 * got["size"]).all()
    goal = {r.source_size: r.target for r in got.itertuples()}
    assert abs(got.drop_duplicates(["source_size", "target"]).target.sum() - sum(sizes.values())) < 1e-6 or len(goal) < len(sizes)
    assert all(t <= 3 * s + 1e-9 for s, t in goal.items()) and len(frame) == len(got)


def test_taken_is_near_the_target(spark, data):
    docs = sample(spark, data)
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()


def test_odd_documents(spark):
    docs = clashing(documents(spark))
    got = mixing.mix(docs)
    assert got.count() == len(ROWS)
    assert rows_of(got.toPandas()) == rows_of(by_sql(documents(spark).toPandas()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("doc_id in (3, 4)")).where("taken <> 0").count() == 0
