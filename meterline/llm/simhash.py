"""SimHash near-duplicates by anchor-point covering (operator 8).

A pair within 4 of 64 bits differs in at most 1 of bits 0-22, or at most 1 of bits 23-45, or in none of bits 46-63:
otherwise it would differ in 2 + 2 + 1 bits. On each 23-bit part the anchors are the 4,096 words of the binary Golay
code, which covers every word within radius 3; on the 18-bit part every word is an anchor (radius 0, threshold 0).
Each fingerprint has one home anchor a part, the nearest, and is replicated to every anchor within covering radius
plus the part's threshold. The home of one of a close pair is thus an anchor of the other, and comparing homes with
replicas anchor by anchor loses no pair. Anchors with many members are split into tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, map_arrow, met_by, settle, small_batches, texts

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
#: Bits of each part: shift, width, whether Golay words are its anchors.
PARTS = ((0, 23, True), (23, 23, True), (46, 18, False))
TILE = 1024
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends[: len(words) - SHINGLE + 1] - [len(w) + 1 for w in words[: len(words) - SHINGLE + 1]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    h = np.array(hashes, dtype="<u8")
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(bits), 255):
        ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of each row of docs; a null text counts as empty and has fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t) for t in texts(batch.column("text"))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of the nearest word, and those of all words within distance 4 (padded by -1)."""
    e = np.arange(1 << 23, dtype=np.uint32)
    e = e[np.bitwise_count(e) <= 4]
    syndrome = e.copy()
    for bit in range(22, 10, -1):
        syndrome ^= ((syndrome >> bit) & 1) * np.uint32(GOLAY << (bit - 11))
    order = np.lexsort((np.bitwise_count(e), syndrome))
    e, syndrome = e[order], syndrome[order]
    first = np.searchsorted(syndrome, np.arange(2048))
    rank = np.arange(len(e)) - first[syndrome]
    table = np.full((2048, rank.max() + 1), -1, np.int64)
    table[syndrome, rank] = e
    return table[:, 0].copy(), table


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index of fingerprint, anchor key, whether it is the home anchor); fp is uint64."""
    index, key, home = [], [], []
    for part, (shift, width, coded) in enumerate(PARTS):
        word = ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        if coded:
            syndrome = word.copy()
            for bit in range(22, 10, -1):
                syndrome ^= ((syndrome >> bit) & 1) * (GOLAY << (bit - 11))
            nearest, near = golay()
            errors = near[syndrome]
            row, column = np.nonzero(errors >= 0)
            sides = ((np.arange(len(fp)), word ^ nearest[syndrome], True), (row, word[row] ^ errors[row, column], False))
        else:
            sides = ((np.arange(len(fp)), word, True), (np.arange(len(fp)), word, False))
        for i, anchor, is_home in sides:
            index.append(i)
            key.append(anchor | (part << 24))
            home.append(np.full(len(i), is_home))
    return np.concatenate(index), np.concatenate(key), np.concatenate(home)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge for each node, joining what the edges (a, b) join: (node, smallest node it reaches)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def compare_runs(key: np.ndarray, home: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of homes with replicas of equal key, rows sorted by key; a bounded number of pairs at a time."""
    h, r = np.nonzero(home)[0], np.nonzero(~home)[0]
    low, high = np.searchsorted(key[r], key[h], "left"), np.searchsorted(key[r], key[h], "right")
    done, total = 0, np.concatenate([[0], np.cumsum(high - low)])
    while done < len(h):
        upto = max(done + 1, int(np.searchsorted(total, total[done] + PAIRS_AT_ONCE, "right")) - 1)
        n = (high - low)[done:upto]
        left = np.repeat(np.arange(done, upto), n)
        right = np.arange(len(left)) - np.repeat(total[done:upto] - total[done], n) + np.repeat(low[done:upto], n)
        a, b = h[left], r[right]
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= THRESHOLD) & (rep[a] != rep[b])
        if near.any():
            yield rep[a[near]], rep[b[near]]
        done = upto


def link(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between representatives that span all links; classes has distinct fp and rep (both long)."""

    def replicate(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        rep = batch.column("rep").to_numpy(zero_copy_only=False).astype(np.int64)
        i, key, home = anchors(fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(fp[i]), pa.array(rep[i])], ["k", "home", "fp", "rep"])

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each class becomes some 60 rows, so that partitions that suit classes are too large for their replicas.
    rows = settle(map_arrow(classes.repartition(parts, "fp"), replicate, "k long, home boolean, fp long, rep long"))
    # Tiles: an anchor with many members is cut into slices of its homes times slices of its replicas. There are
    # 2 * 4,096 + 2 ** 18 anchors, whatever the rows, so that the crowded ones can be broadcast.
    crowd = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > 2 * TILE).select("k", F.ceil(F.col("n") / (2 * TILE)).cast("int").alias("slices"))
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("long")
    tiled = (
        rows.join(F.broadcast(crowd), "k", "left")
        .withColumn("slices", F.coalesce("slices", F.lit(1)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(F.xxhash64("k", F.when(F.col("home"), own).otherwise(F.col("other").cast("long")), F.when(F.col("home"), F.col("other").cast("long")).otherwise(own)).alias("tile"), "k", "home", "fp", "rep")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in _with_end(batches):
            if batch is not None:
                got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "home", "fp", "rep")]
                got[1] = got[1].astype(bool)
                kept = got if kept is None else [np.concatenate(x) for x in zip(kept, got)]
                if len(kept[0]) < 1 << 16:
                    continue
                cut = int(np.searchsorted(kept[0], kept[0][-1]))  # the last tile may go on in the next batch
            else:
                cut = 0 if kept is None else len(kept[0])
            if not cut:
                continue
            tile, home, fp, rep = (x[:cut] for x in kept)
            kept = [x[cut:] for x in kept]
            for a, b in compare_runs(tile, home, fp.view(np.uint64), rep):
                x, y = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return tiled.select("tile", "home", "fp", "rep").repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(compare, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def groups(fps: DataFrame) -> DataFrame:
    """(fp, component) of each fingerprint of fps; a component is named by a number of its own, as ids can repeat."""
    classes = settle(fps.groupBy("fp").agg(F.lit(1).alias("one")).select("fp", F.monotonically_increasing_id().alias("rep")))
    component = connected_components(link(classes))
    return classes.join(component, classes.rep == component.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs.

    Equal fingerprints are one class; classes are linked by the anchors. Nulls: a null text counts as empty; a row
    with a null doc_id gets the smallest id that shares its component, or null if none has one. Rows of one id whose
    texts differ can be of different components. Repeated rows give repeated results. An empty table gives none. Only
    doc_id and text are read, whatever other columns there are.
    """
    fps = settle(fingerprints(docs))
    group = groups(fps)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(group, "fp")
    named = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = met_by(group, named, "component", "fp").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one of each component stays: that with the smallest id, nulls last.

    Of rows with that id the one of the smallest fingerprint stays, if it is of that component; of equal ones any.
    """
    fps = settle(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("first")
    chosen = fps.distinct().join(groups(fps), "fp").groupBy("component").agg(first).select("first.doc_id", "first.fp")
    rows = fps.groupBy("doc_id").agg(F.count("*").alias("n")).withColumnRenamed("doc_id", "id")
    chosen = settle(chosen.join(rows, F.col("doc_id").eqNullSafe(F.col("id"))).select(F.col("id").alias("chosen_id"), F.col("fp").alias("chosen_fp"), (F.col("id").isNull() | (F.col("n") > 1)).alias("several")))
    once = docs.join(chosen.where("not several"), docs.doc_id == F.col("chosen_id"), "left_semi")
    # Rows that share an id, or have none, are told apart by their fingerprints. Where there are none, texts move once.
    several = chosen.where("several")
    if several.isEmpty():
        return once.select(docs.columns)
    own = next(f"fp{i}" for i in range(len(docs.columns) + 1) if f"fp{i}" not in docs.columns)
    at = docs.columns.index("text")

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t) for t in texts(batch.column(at).cast(pa.string()))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.view(np.int64))], [*batch.schema.names, own])

    rest = docs.join(several.select("chosen_id").distinct(), docs.doc_id.eqNullSafe(F.col("chosen_id")), "left_semi")
    rest = map_arrow(rest, marked, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    rest = rest.join(several, rest.doc_id.eqNullSafe(F.col("chosen_id")) & (rest[own] == F.col("chosen_fp")), "left_semi").dropDuplicates(["doc_id", own])
    return once.select(docs.columns).unionByName(rest.select(docs.columns))
