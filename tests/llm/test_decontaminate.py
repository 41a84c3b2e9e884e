from __future__ import annotations

import random
import time

import numpy as np
import pytest

from meterline.llm import decontaminate as d

from .fixtures import clashing, documents, sample


def plain_tiles(a: list[int], b: list[int], least: int) -> set[tuple[int, int, int]]:
    """The rule by nested loops."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), set()
    while True:
        best = []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and a[i + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= least:
                    best.append((-n, i, j))
        if not best:
            return tiles
        longest = min(best)[0]
        for n, i, j in sorted(best):
            if n == longest and all(free_a[i : i - n]) and all(free_b[j : j - n]):
                for x in range(-n):
                    free_a[i + x] = free_b[j + x] = False
                tiles.add((i, j, -n))


def test_tiles_equal_nested_loops():
    r = random.Random(1)
    for _ in range(60):
        b = [r.randrange(1, 6) for _ in range(r.randrange(0, 25))]
        a = [r.randrange(0, 6) for _ in range(r.randrange(0, 15))] + b[10:] + [0] + b[:10]
        assert set(d.tile(np.array(a, np.int64), np.array(b, np.int64), 3)) == plain_tiles(a, b, 3)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


WORDS = [f"w{i}" for i in range(40)]
ITEM = " ".join(WORDS)


@pytest.fixture(params=["index", "table", "narrow filter"])
def way(request, monkeypatch):
    """A small benchmark by its index, and as if it were a large one."""
    if request.param != "index":
        monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    if request.param == "narrow filter":
        monkeypatch.setattr(d, "MOST_BITS", 1 << 4)


def test_reordered_and_damaged_passages_are_found(spark, way):
    parts = [WORDS[i : i + 10] for i in range(0, 40, 10)]
    moved = " ".join(w for p in reversed(parts) for w in [*p, "between"]).upper()
    half = "x y z " + " ".join(WORDS[:20])
    less = "x y z " + " ".join(WORDS[:19])
    scattered = " ".join(w for i in range(0, 40, 4) for w in [*WORDS[i : i + 4], "no"])
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate((moved, half, less, scattered, ITEM))])
    got = {r.doc_id: (r.matched, r.item_words) for r in d.overlaps(docs, bench(spark, [(1, ITEM)])).collect()}
    assert got == {0: (40, 40), 1: (20, 40), 4: (40, 40)}
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, bench(spark, [(1, ITEM)])).collect()) == [2, 3]


def test_short_items(spark, way):
    items = bench(spark, [(1, "one two"), (2, ITEM), (3, None), (None, "lost"), (4, ""), (5, "a b c d e f")])
    docs = documents(spark, [(1, "zero one two three", "en", "s", 1), (2, "a b c d e f g " + ITEM, "en", "s", 1)])
    got = sorted((r.doc_id, r.item_id) for r in d.overlaps(docs, items).collect())
    assert got == [(1, 1), (2, 2), (2, 5)]


def test_documents_that_hold_items_are_found_and_no_others(spark, data, way):
    docs, items = sample(spark, data), spark.read.parquet(f"{data}/benchmark.parquet")
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    texts = {r.item_id: " " + " ".join(words(r.text)) + " " for r in items.collect()}
    whole = {r.doc_id for r in docs.collect() if any(t in " " + " ".join(words(r.text)) + " " for t in texts.values())}
    got = {r.doc_id for r in d.overlaps(docs, items).collect()}
    assert whole <= got
    seeds = {tuple(w[i : i + 5]) for t in texts.values() for w in [t.split()] for i in range(len(w) - 4)}
    for r in docs.where("text is not null").collect():
        w = words(r.text)
        if r.doc_id in got - whole:
            assert any(tuple(w[i : i + 5]) in seeds for i in range(len(w) - 4))


def test_odd_documents(spark, way):
    docs = clashing(documents(spark))
    items = bench(spark, [(1, "jumps over the lazy dog and runs"), (1, "jumps over the lazy dog and runs")])
    assert sorted(r.doc_id for r in d.overlaps(docs, items).collect()) == [1, 2, 2]
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 7
    assert d.overlaps(docs.limit(0), items).count() == 0 == d.overlaps(docs, items.limit(0)).count()
    assert d.drop_contaminated(docs, items.limit(0)).count() == 10


def test_a_large_benchmark_gives_what_a_small_one_does(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted((r.doc_id, r.item_id, r.matched, r.item_words, [tuple(t) for t in r.tiles]) for r in d.overlaps(docs, items, 0.1).collect())
    kept = lambda: sorted(r.doc_id for r in d.drop_contaminated(docs, items).collect())
    small = (rows(), kept())
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    assert (rows(), kept()) == small and len(small[0]) > 10 and len(small[1]) < docs.count()


def rounds(a, b, least):
    """Greedy string tiling, round by round: all longest matches of unmarked words, by position."""
    free_a, free_b, tiles = [x > 0 for x in a], [x > 0 for x in b], []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((i, j, n))
        if best < least:
            return tiles
        for i, j, n in found:
            if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n] = free_b[j : j + n] = [False] * n
                tiles.append((i, j, n))


def test_tiles_of_texts_that_repeat_themselves():
    random = np.random.default_rng(3)
    for _ in range(60):
        a, b = (random.integers(0, random.integers(2, 5), random.integers(1, 60)) for _ in range(2))
        least = int(random.integers(1, 6))
        assert d.tile(a, b, least) == rounds(a.tolist(), b.tolist(), least)
    cycle = np.arange(1, 6)
    for n, m in ((1600, 800), (20_000, 800), (5, 20_000)):
        began = time.perf_counter()
        assert sum(t[2] for t in d.tile(np.tile(cycle, n // 5), np.tile(cycle, m // 5), 5)) == min(n, m)
        assert time.perf_counter() - began < 2
