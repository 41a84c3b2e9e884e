"""Benchmark decontamination by greedy string tiling (operator 5).

The benchmark is the stated query set. Where documents and items share Karp-Rabin seeds of MIN_MATCH words, the pair is
tiled: the longest match of unmarked words is marked again and again until none of MIN_MATCH words is left. The share of
the item's words under tiles is its coverage, which doesn't depend on the order of passages.

A benchmark of BROADCAST_BYTES at most is an index that is broadcast, and pairs are found and tiled where the documents
are. The seeds of a larger one stay a table: the documents are scanned once with a filter of bits, which is of bounded
size and passes every seed that an item has; what passes is joined with the items' seeds, and the pairs with their texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle, small_batches, texts

MIN_MATCH, COVERAGE = 5, 0.5
BROADCAST_BYTES = 8 << 20
#: Bits of the filter for each seed of the benchmark, and at most: 32 MB; beyond, more seeds pass that no item has.
BITS_A_SEED, MOST_BITS = 16, 1 << 28
#: The base of the rolling hash, any odd number of 64 bits.
BASE = 0x9E3779B97F4A7C15


def roll(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2^64, of every k words in a row."""
    h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(BASE) + ids[j : j + len(h)].astype(np.uint64)
    return h


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def runs(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of every match of `least` words or more that can't be extended; id 0 matches nothing.

    Words of a that lie in no seed, by the running Karp-Rabin hashes of `least` words, are passed over. At each other
    word of a, `length` holds how many words match up to it and each word of b: one row of the table of matches.
    """
    hash_a, hash_b = roll(a, least), roll(b, least)
    seed = np.isin(hash_a, hash_b)
    covered = np.convolve(seed, np.ones(least, int)) > 0 if len(hash_a) else np.zeros(len(a), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # ends in b and lengths, of those that end before a word of a
    ends: list[int] = []
    length, none = np.zeros(len(b), np.int32), np.zeros(len(b), np.int32)

    def ended(i: int, over: np.ndarray) -> None:
        j = np.flatnonzero(over)
        if len(j):
            found.append((j + 1, length[j]))
            ends.append(i)

    last = -1
    for i in np.flatnonzero(covered & (a > 0)).tolist():
        if i != last + 1:
            ended(last + 1, length >= least)
            length = none
        same = b == a[i]
        over = length >= least
        over[:-1] &= ~same[1:]
        ended(i, over)
        longer = np.empty_like(length)
        longer[0] = 0
        np.add(length[:-1], 1, out=longer[1:])
        longer[0] = 1
        longer *= same
        length, last = longer, i
    ended(last + 1, length >= least)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    n = np.concatenate([x for _, x in found]).astype(np.int64)
    return np.repeat(ends, [len(x) for x, _ in found]) - n, np.concatenate([x for x, _ in found]) - n, n


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word ids a and b: (start in a, start in b, length), longest first, ties by position.

    Of the longest matches of unmarked words the first is marked, again and again. What a mark cuts off a match goes back
    with its own length, so that each match is looked at once for each tile that touches it.
    """
    starts_a, starts_b, lengths = runs(a, b, least)
    order = np.lexsort((starts_b, starts_a, -lengths))
    queue = [(-int(lengths[x]), int(starts_a[x]), int(starts_b[x])) for x in order[::-1]]
    cut: list[tuple[int, int, int]] = []  # a heap
    tiles, free_a, free_b, left = [], np.ones(len(a), bool), np.ones(len(b), bool), len(b)
    while (queue or cut) and left >= least:
        n, i, j = queue.pop() if queue and (not cut or queue[-1] < cut[0]) else heappop(cut)
        free = free_a[i : i - n] & free_b[j : j - n]
        if free.all():
            free_a[i : i - n] = free_b[j : j - n] = False
            tiles.append((i, j, -n))
            left += n
        elif free.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if end - begin >= least:
                    heappush(cut, (begin - end, i + begin, j + begin))
    return tiles


class Block:
    """An index of some benchmark items: word ids, hashes of MIN_MATCH words, and which items have them."""

    def __init__(self, items: list[tuple[int, bytes]], least: int) -> None:
        self.least, self.vocabulary = least, {}
        self.items = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                self.items.append((item_id, np.array(ids, np.int64)))
        # An item of fewer words than MIN_MATCH is sought as a whole.
        self.lengths = sorted({min(least, len(ids)) for _, ids in self.items})
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in self.lengths:
            own = [(i, roll(ids, k)) for i, (_, ids) in enumerate(self.items) if min(least, len(ids)) == k]
            h = np.concatenate([x for _, x in own])
            which = np.concatenate([np.full(len(x), i) for i, x in own])
            order = np.argsort(h, kind="stable")
            self.seeds[k] = (h[order], which[order])

    def matches(self, text: bytes) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(item id, covered words, the item's words, tiles) of every item that shares a seed with the text."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], np.int64)
        for k in self.lengths:
            if len(ids) < k:
                continue
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            whole = np.nonzero(known[k:] - known[:-k] == k)[0]
            if not len(whole):
                continue
            h, (seeds, which) = roll(ids, k)[whole], self.seeds[k]
            low, high = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            for i in sorted({int(x) for p, q in zip(low, high) if q > p for x in which[p:q]}):
                item_id, item = self.items[i]
                tiles = tile(ids, item, k)
                if tiles:
                    yield item_id, sum(t[2] for t in tiles), len(item), tiles


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) of the benchmark, each once; null ids and texts are left out."""
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()


def is_small(items: DataFrame) -> bool:
    return (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES


def index(items: DataFrame) -> Block:
    """The index of a small benchmark."""
    return Block([(r.item_id, r.text.encode()) for r in items.orderBy("item_id", "text").collect()], MIN_MATCH)


PAIRS = "doc_id long, item_id long, matched long, item_words long, tiles array<struct<doc_at: int, item_at: int, words: int>>"


def overlaps(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched, item_words, tiles array of (doc_at, item_at, words)) of every pair that reaches coverage.

    Words are split at ASCII white space and A-Z lower-cased. Null and empty texts match nothing. Documents that repeat
    give repeated rows. Without benchmark or documents there is no row. Columns beside the ids and texts aren't read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items_of(benchmark)
    if not is_small(items):
        return map_arrow(candidates(source, items), lambda batch: found_pairs(tile_pairs(batch, coverage)), PAIRS)
    shared = docs.sparkSession.sparkContext.broadcast(index(items))

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        return found_pairs(
            (d, i, n, of, tiles)
            for d, t in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")))
            for i, n, of, tiles in shared.value.matches(t)
            if n >= coverage * of
        )

    return map_arrow(source, run, PAIRS)


def found_pairs(pairs: Iterable[tuple]) -> pa.Table | None:
    rows = [{"doc_id": d, "item_id": i, "matched": n, "item_words": of, "tiles": [{"doc_at": x, "item_at": y, "words": z} for x, y, z in tiles]} for d, i, n, of, tiles in pairs]
    return pa.Table.from_pylist(rows, ARROW) if rows else None


def seeds_of(own: list[bytes], k: int) -> np.ndarray:
    """The distinct hashes of every k words in a row, which tell lengths apart too."""
    ids = np.array([xxhash.xxh64_intdigest(w) for w in own], np.uint64)
    return np.unique(roll(ids, k) * np.uint64(2) + np.uint64(k))


def seeded(items: DataFrame) -> DataFrame:
    """(seed, k, item) of the seeds of all items; one of fewer words than MIN_MATCH has one seed, of all."""

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        seeds, lengths, at = [], [], []
        for i, t in enumerate(texts(batch.column("text"))):
            own = words(t)
            k = min(MIN_MATCH, len(own))
            if k:
                seeds.append(seeds_of(own, k))
                lengths += [k] * len(seeds[-1])
                at += [i] * len(seeds[-1])
        if not seeds:
            return None
        return pa.table({"seed": np.concatenate(seeds).view(np.int64), "k": pa.array(lengths, pa.int32()), "item": batch.column("item").take(pa.array(at))})

    return map_arrow(items, run, "seed long, k int, item long")


def bits(seeds: DataFrame, size: int) -> np.ndarray:
    """A filter of `size` bits, a power of 2, in which each seed's is set; each partition gives one, and the driver holds two."""
    shift = np.uint64(64 - size.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, bool)
        for batch in batches:
            own[spread(batch.column("seed").to_numpy().view(np.uint64)) >> shift] = True
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in seeds.select("seed").mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def spread(seeds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (seeds ^ (seeds >> np.uint64(29))) * np.uint64(BASE)


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, item_id, item_text) of each row of docs and each item that share a seed, with items of any size.

    One scan of the documents by the filter, then joins of what passes: seeds with items, pairs with their texts.
    """
    spark = docs.sparkSession
    items = settle(items.withColumn("item", F.monotonically_increasing_id()))
    seeds = settle(seeded(items))
    count = seeds.count()
    size = min(MOST_BITS, max(1 << 10, 1 << (count * BITS_A_SEED).bit_length()))
    shift, lengths = np.uint64(64 - size.bit_length() + 1), sorted(r.k for r in seeds.select("k").distinct().collect())
    filter_ = spark.sparkContext.broadcast(bits(seeds, size))

    def passing(batch: pa.RecordBatch) -> pa.Table | None:
        at, hits = [], []
        for i, t in enumerate(texts(batch.column("text"))):
            own = words(t)
            found = [seeds_of(own, k) for k in lengths if len(own) >= k]
            all_ = np.concatenate(found) if found else np.zeros(0, np.uint64)
            place = (spread(all_) >> shift).astype(np.int64)
            all_ = all_[(filter_.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0]
            if len(all_):
                at.append(i)
                hits.append(all_.view(np.int64))
        if not at:
            return None
        return pa.table({**{c: batch.column(c).take(pa.array(at)) for c in ("ref", "doc_id", "text")}, "seeds": pa.array(hits, pa.list_(pa.int64()))})

    hit = settle(map_arrow(docs.withColumn("ref", F.monotonically_increasing_id()).select("ref", "doc_id", "text"), passing, "ref long, doc_id long, text string, seeds array<long>"))
    pairs = hit.select("ref", F.explode("seeds").alias("seed")).join(seeds.select("seed", "item"), "seed").select("ref", "item").distinct()
    return pairs.join(hit.select("ref", "doc_id", "text"), "ref").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").select("doc_id", "text", "item_id", "item_text")


def tile_pairs(batch: pa.RecordBatch, coverage: float) -> Iterator[tuple]:
    for d, text, i, item in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), batch.column("item_id").to_pylist(), texts(batch.column("item_text"))):
        number: dict[bytes, int] = {}
        b = np.array([number.setdefault(w, len(number) + 1) for w in words(item)], np.int64)
        a = np.array([number.get(w, 0) for w in words(text)], np.int64)
        tiles = tile(a, b, min(MIN_MATCH, len(b)))
        n = sum(t[2] for t in tiles)
        if tiles and n >= coverage * len(b):
            yield d, i, n, len(b), tiles


ARROW = pa.schema({"doc_id": pa.int64(), "item_id": pa.int64(), "matched": pa.int64(), "item_words": pa.int64(), "tiles": pa.list_(pa.struct({"doc_at": pa.int32(), "item_at": pa.int32(), "words": pa.int32()}))})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns, whose text covers no benchmark item to that share."""
    small_batches(docs.sparkSession)
    items = items_of(benchmark)
    if not is_small(items):
        digest = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)

        def covered(batch: pa.RecordBatch) -> pa.RecordBatch:
            places = {x[0] for x in tile_pairs(batch.set_column(0, "doc_id", pa.array(range(batch.num_rows))), coverage)}
            return pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(sorted(places), pa.int64()))], ["digest"])

        found = candidates(docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), items).withColumn("digest", digest("text"))
        bad = settle(map_arrow(found, covered, "digest string").distinct().withColumnRenamed("digest", "_bad"))
        return docs.join(bad, digest("text") == F.col("_bad"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(index(items))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = [not any(n >= coverage * of for _, n, of, _ in shared.value.matches(t)) for t in texts(batch.column("text"))]
        return batch.filter(pa.array(clean))

    return map_arrow(docs, run, docs.schema)
