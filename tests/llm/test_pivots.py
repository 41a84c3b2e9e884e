from __future__ import annotations

import numpy as np
import pytest

from meterline.llm import pivots


def brute(rows: list[tuple[int, list | None]]) -> dict[int, tuple[int, int]]:
    sound = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in sound]
    links = {i: set() for i, _ in rows}
    n = {i: 0 for i, _ in rows}
    for p, (i, u) in enumerate(sound):
        for q, (j, w) in enumerate(sound):
            if p < q and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= 0.95:
                links[i].add(j), links[j].add(i)
                n[i] += 1
                n[j] += 1
    label = {i: i for i, _ in rows}
    while True:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in label}
        if new == label:
            return {i: (n[i], label[i]) for i in label} if ids else {i: (0, i) for i in label}
        label = new


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force_on_clusters(spark, seed, monkeypatch):
    monkeypatch.setattr(pivots, "TILE", 32)
    random = np.random.default_rng(seed)
    vectors = []
    for c in random.normal(size=(40, 24)):
        vectors += [(c + random.normal(size=24) * random.choice([0.02, 0.15, 0.3])).tolist() for _ in range(random.integers(1, 12))]
    vectors += vectors[:20] + [[3 * x for x in v] for v in vectors[:5]]
    rows = list(enumerate(vectors))
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(frame(spark, rows)).collect()}
    expected = brute(rows)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in expected.values())
    assert all(got[i][0] <= expected[i][0] for i in expected)  # no link below the threshold
    assert found >= 0.98 * there


def planted(random: np.random.Generator, n: int, width: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and one more for each at a cosine between low and high."""
    a = pivots.units(random.normal(size=(n, width)))
    b = random.normal(size=a.shape)
    b = pivots.units(b - (a * b).sum(axis=1, keepdims=True) * a)
    cosine = random.uniform(low, high, (n, 1))
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def test_recall_of_planted_links_with_more_vectors_than_pivots(spark):
    """Pairs, one group wider than a ball, one as narrow, and unrelated vectors."""
    random = np.random.default_rng(5)
    a, b = planted(random, 600, 32, 0.951, 0.97)
    group = pivots.units(random.normal(size=32) + 0.13 * random.normal(size=(300, 32)))
    tight = pivots.units(random.normal(size=32) + 0.05 * random.normal(size=(300, 32)))
    v = np.concatenate([a, b, group, tight, random.normal(size=(1500, 32))])
    assert len(v) > int(4 * len(v) ** 0.5) > pivots.FEWEST
    u = pivots.units(v)
    near = u @ u.T >= pivots.THRESHOLD
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in pivots.near_vectors(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])).collect()}
    n = np.array([got[i].n_links for i in range(len(v))])
    assert (n <= near.sum(axis=1)).all()
    assert n[:1200].sum() >= 0.95 * near[:1200].sum() and n.sum() >= 0.97 * near.sum()
    assert (n[1500:1800] == near[1500:1800].sum(axis=1)).all() and len({got[i].component_id for i in range(1500, 1800)}) == 1
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_balls_count_what_they_meet_in_part(spark, monkeypatch):
    """Groups of all widths around the same centres, in slices: as many links as by brute force."""
    monkeypatch.setattr(pivots, "TILE", 50)
    monkeypatch.setattr(pivots, "FEWEST", 16)
    monkeypatch.setattr(pivots, "MOST", 16)
    random = np.random.default_rng(9)
    v = np.concatenate([c + random.uniform(0, 0.35, (150, 1)) * random.normal(size=(150, 6)) for c in 2 * random.normal(size=(4, 6))])
    v = np.concatenate([v, v[:40]])
    u = pivots.units(v)
    near = u @ u.T >= pivots.THRESHOLD
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])).collect()}
    n = np.array([got[i] for i in range(len(v))])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.99 * near.sum()


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.0, 1.0]), (1, [1.0, 0.0005])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pivots.near_vectors(frame(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]
    got = pivots.near_vectors(frame(spark, [(None, [1.0, 0.0]), (None, [1.0, 0.1]), (7, [0.0, 1.0]), (8, [0.1, 1.0]), (None, [0.0, 1.1])])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 1, 0, False), (0, 1, 0, False), (0, 2, 7, False), (7, 2, 7, True), (8, 2, 7, False)]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, None]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [1e200, 1e190]), (12, [5e-324, 0.0])]
    got = pivots.near_vectors(frame(spark, rows).withColumn("v", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x")))
    expected = {1: (4, 1), 2: (4, 1), 3: (4, 1), 11: (4, 1), 12: (4, 1)} | {i: (0, i) for i in (4, 5, 6, 7, 8, 9, 10)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == expected
    assert {r.vec_id for r in got.collect() if r.kept} == {1, 4, 5, 6, 7, 8, 9, 10}
    repeated = pivots.near_vectors(frame(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])])).collect()
    assert len(repeated) == 3
    assert pivots.near_vectors(frame(spark, rows).limit(0)).count() == 0
