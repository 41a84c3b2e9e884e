from __future__ import annotations

import numpy as np
import pytest

from meterline.llm import whitening

from .fixtures import clashing


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, label int")


def check(got, vectors, components=32):
    """got against numpy's covariance and eigenvalues; vectors {vec_id: vector}."""
    ids = sorted(vectors)
    x = np.floor(64 * np.array([vectors[i] for i in ids], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = n * x - s
    exact = centred / n
    covariance = exact.T @ exact / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    k = min(components, x.shape[1])
    by_id = {(r.vec_id, r.component): r for r in got}
    assert sorted(by_id) == [(i, c) for i in ids for c in range(1, k + 1)] and len(got) == len(by_id)
    white = np.array([[by_id[i, c].whitened for c in range(1, k + 1)] for i in ids])
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-9
    axes = np.linalg.lstsq(exact, white, rcond=None)[0] * np.sqrt(values[:k])  # unit eigenvectors, either sign
    assert np.allclose(np.linalg.norm(axes, axis=0), 1) and np.allclose(covariance @ axes, axes * values[:k], rtol=1e-9, atol=1e-9 * values[0])
    for j, i in enumerate(ids):
        assert {by_id[i, c].deviation for c in range(1, k + 1)} == {int((centred[j].astype(object) ** 2).sum())}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for c in range(1, k + 1):
        assert [by_id[i, c].explained for i in ids] == pytest.approx([values[c - 1] / values.sum()] * n, rel=1e-9)


@pytest.mark.parametrize("parts", [1, 70])
def test_equals_numpy(spark, data, parts):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    check(whitening.whitened(df.repartition(parts)).collect(), vectors)


@pytest.mark.parametrize("matrix", ["random", "diagonal", "equal", "low", "one", "graded"])
def test_symmetric_qr(matrix):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 40))
    a = {
        "random": a @ a.T, "diagonal": np.diag(rng.normal(size=12)), "equal": np.eye(9) * 4, "low": a[:, :5] @ a[:, :5].T, "one": a[:1, :1],
        "graded": (lambda q: (q * np.logspace(0, -10, 40)) @ q.T)(np.linalg.qr(a)[0]),
    }[matrix]
    values, rows = whitening.symmetric_qr(a)
    scale = np.abs(a).max()
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * scale * len(a))
    assert np.allclose(rows @ rows.T, np.eye(len(a)), atol=1e-12) and np.allclose(rows.T @ (values[:, None] * rows), (a + a.T) / 2, atol=1e-12 * scale * len(a))


def test_merged_states_equal_one_pass():
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 3, size=(200, 6))
    whole = whitening.Welford(6)
    whole.update(x)
    state = None
    for part in np.split(x, [1, 30, 31, 150]):
        own = whitening.Welford(6)
        own.update(part)
        own = whitening.State(own.n, own.total, own.mean, own.products)
        state = own if state is None else state.merged(own)
    assert state.n == 200 and np.allclose(state.mean, whole.mean, rtol=1e-14)
    assert np.allclose(state.products, whole.products, rtol=1e-10) and np.allclose(state.products / 200, np.cov(x.T, bias=True), rtol=1e-8)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = {i: rng.normal(size=3).tolist() for i in range(20)}
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 1.0], [1.0, -float("inf"), 0.0], [1e300, 0.0, 0.0]]
    df = clashing(frame(spark, [*good.values(), *bad], [*good, *range(100, 107)])).repartition(3)
    check(whitening.whitened(df).collect(), good)
    assert whitening.whitened(df.where("vec_id >= 100")).count() == 0
    assert whitening.whitened(df.limit(0)).count() == 0


def test_vectors_of_no_variance_repeated_rows_and_lengths(spark):
    assert whitening.whitened(frame(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whitened(frame(spark, [[1.0, 2.0]] * 9)).count() == 0
    got = whitening.whitened(frame(spark, [[1.0, 5.0], [1.0, 5.0], [-1.0, 5.0]], [1, 1, None])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)] and got[0].explained == 1
    rng = np.random.default_rng(2)
    short, long_ = {i: rng.normal(size=2).tolist() for i in range(9)}, {i: rng.normal(size=4).tolist() for i in range(10, 25)}
    got = whitening.whitened(frame(spark, [*short.values(), *long_.values()], [*short, *long_])).collect()
    check([r for r in got if r.vec_id < 10], short)
    check([r for r in got if r.vec_id >= 10], long_)


def test_sums_beyond_a_long_are_exact(spark):
    large = [[2.0**30 * i, float(i % 3)] for i in range(400)]
    got = whitening.whitened(frame(spark, large)).collect()
    x = np.floor(64 * np.array(large)).astype(np.int64).astype(object) + 1_000_000
    want = [int(v) for v in ((400 * x - x.sum(axis=0)) ** 2).sum(axis=1)]
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got) and max(want) >= 1 << 63
