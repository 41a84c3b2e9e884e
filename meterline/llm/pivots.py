"""Embedding near-duplicates with a pivot-permutation index (operator 2).

A vector is described by its NEAREST nearest of a set of reference points, in order. Two vectors that share SHARED of
them are candidates and are verified by cosine in double precision. The inverted lists hold, for each two pivots, what
has both among its nearest; a pair is looked at in the list of its two smallest shared pivots alone, so that links can
be counted without listing them.

Tight groups are balls: vectors around the mean of a pivot's vectors, near enough to it that any two of them are linked.
A ball has no pairs of its own to look at, and stands in the lists as one entry, with its weight and radius. By the
triangle inequality it is linked wholly, or not at all, with most of what it meets; for the rest its members are compared.
What stays quadratic is a group that is linked but too wide for balls; long lists are cut into tiles of bounded size.
Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, met_by, settle, small_batches
from .simhash import _with_end, forest

THRESHOLD = 0.95
NEAREST, SHARED = 6, 2
#: There are about 4 pivots for the square root of the vectors; this many at least and at most.
FEWEST, MOST = 64, 4096
#: Reference points are drawn from this many vectors a pivot, those of the smallest hashes.
FIT_ON = 4
#: Balls reach this far from their centre, in parts of the angle of THRESHOLD (any two within a half are linked), and
#: are made where so many vectors are that near.
REACH, LEAST_BALL = 0.44, 8
TILE, SIDE_BY_SIDE = 4096, 256
ANGLE = float(np.arccos(THRESHOLD))
MARGIN = 1e-6
COUNT, EDGE, WHOLE, PARTLY = range(4)
FOUND = "kind int, a long, b long, n long, m long"


def fit(vectors: DataFrame, pivots: int | None = None) -> np.ndarray:
    """Reference points from a bounded sample: each next one is the sampled vector farthest from those chosen."""
    if pivots is None:
        pivots = min(MOST, max(FEWEST, int(4 * vectors.count() ** 0.5)))
    rows = np.array([r.v for r in vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots * FIT_ON).collect()], float)
    if not len(rows):
        return rows.reshape(0, 1)
    rows = units(rows)
    chosen, best = [0], rows @ rows[0]
    while len(chosen) < min(pivots, len(rows)):
        i = int(np.argmin(best))
        if best[i] > 1 - 1e-9:
            break
        chosen.append(i)
        best = np.maximum(best, rows @ rows[i])
    return rows[chosen]


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of a list column whose rows are of one length."""
    return units(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float))


def units(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / np.where(largest > 0, largest, 1)  # squares of very large or small components stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def describe(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(node, v, members, near) of each row: its nearest pivots, nearest first, ties by number."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(matrix(batch.column("v")) @ shared.value.T), axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "v", "members")), near], ["node", "v", "members", "near"])

    return vectors.select("node", "v", "members").mapInArrow(run, f"node long, v {vectors.schema['v'].dataType.simpleString()}, members long, near array<int>")


def centres(described: DataFrame, pivots: np.ndarray) -> dict[int, np.ndarray]:
    """Of each pivot with LEAST_BALL vectors or more that are nearest to it and linked with it, their mean direction."""
    shared = described.sparkSession.sparkContext.broadcast(pivots)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(shared.value), np.int64), np.zeros(shared.value.shape)
        for batch in batches:
            if batch.num_rows:
                rows, first = matrix(batch.column("v")), nearest(batch)
                close = (rows * shared.value[first]).sum(axis=1) >= THRESHOLD
                np.add.at(total, first[close], rows[close])
                n += np.bincount(first[close], minlength=len(n))
        yield sums(np.flatnonzero(n), n, total)

    def sums(pivot: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(n[pivot]), pa.array([x.tobytes() for x in total[pivot]], pa.binary())], ["pivot", "n", "total"])

    def joined(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in rows.column("total").to_pylist())
        return pa.table({"pivot": rows.column("pivot").slice(0, 1), "n": [sum(rows.column("n").to_pylist())], "total": pa.array([total.tobytes()], pa.binary())})

    schema = "pivot int, n long, total binary"
    found = described.select("v", "near").mapInArrow(summed, schema).groupBy("pivot").applyInArrow(joined, schema).where(F.col("n") >= LEAST_BALL).collect()
    return {r.pivot: units(np.frombuffer(r.total)[None])[0].astype(np.float32) for r in found}  # a row a pivot at most


def nearest(batch: pa.RecordBatch) -> np.ndarray:
    near = batch.column("near")
    return near.flatten().to_numpy().reshape(len(near), -1)[:, 0]


def balled(described: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """described with ball, the pivot of the ball that a row is in or null, and its angle to the centre."""
    shared = described.sparkSession.sparkContext.broadcast(centre)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in described.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, angle = nearest(batch), np.full(batch.num_rows, np.inf)
            there = np.flatnonzero(np.isin(first, list(shared.value))) if shared.value else np.zeros(0, int)
            if len(there):
                middle = units(np.array([shared.value[p] for p in first[there].tolist()], float))
                angle[there] = angles((matrix(batch.column("v"))[there] * middle).sum(axis=1))
            out = angle > REACH * ANGLE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, mask=out), pa.array(angle, mask=out)], [*batch.schema.names, "ball", "angle"])

    return described.mapInArrow(run, schema + ", ball int, angle double")


def keys(near: Column, size: int) -> Column:
    """A long for each two of some pivots; one for a single pivot."""
    of_two = [(near[i], near[j]) for i, j in combinations(range(size), SHARED)] or [(near[0], near[0])]
    return F.array(*[F.shiftleft(F.least(p, q).cast("long"), 32) + F.greatest(p, q) for p, q in of_two])


Rows = dict[str, np.ndarray]


def arrays(table: pa.Table) -> Rows:
    """The columns of a table: v as unit vectors, lists as rows of a matrix."""
    out: Rows = {}
    for name in table.column_names:
        column = table.column(name).combine_chunks()
        if name == "v":
            out[name] = matrix(column)
        elif pa.types.is_list(column.type):
            out[name] = column.flatten().to_numpy().reshape(len(column), -1)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def tiles(of: Callable[[Rows], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by key, low and high: `of` the rows of each tile of two or more, of which at most 8,192 are held beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is not None:
                kept = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
                if kept.num_rows < 1 << 13:
                    continue
            if kept is None or not kept.num_rows:
                continue
            new = np.zeros(kept.num_rows, bool)
            new[0] = True
            for c in ("key", "low", "high"):
                column = kept.column(c).to_numpy()
                new[1:] |= column[1:] != column[:-1]
            bounds = np.flatnonzero(new)
            if batch is None:
                bounds = np.append(bounds, kept.num_rows)
            now, out = arrays(kept.slice(0, int(bounds[-1]))), []
            more = np.diff(bounds) > 1
            for lo, hi in zip(bounds[:-1][more].tolist(), bounds[1:][more].tolist()):
                out += of({name: x[lo:hi] for name, x in now.items()})
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()
            kept = kept.slice(int(bounds[-1])) if batch is not None else None

    return run


def found_rows(kind: int, a: np.ndarray, b: np.ndarray | None, n: np.ndarray, m: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), none if b is None else pa.array(b), pa.array(n.astype(np.int64)), none if m is None else pa.array(m)], ["kind", "a", "b", "n", "m"]
    )


def links(node: np.ndarray, weight: np.ndarray, left: np.ndarray, block: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counts of each node's links, and edges that span them; block gives the linked places of some of left."""
    n, edges = np.zeros(len(node), np.int64), []
    for at in range(0, len(left), SIDE_BY_SIDE):
        x, y = block(left[at : at + SIDE_BY_SIDE])
        if len(x):
            n += np.bincount(x, weight[y], len(node)).astype(np.int64) + np.bincount(y, weight[x], len(node)).astype(np.int64)
            edges.append(forest(node[x], node[y]))
    if edges:
        some = np.flatnonzero(n)
        yield found_rows(COUNT, node[some], None, n[some])
        a, b = forest(*(np.concatenate(x) for x in zip(*edges)))
        yield found_rows(EDGE, a, b, np.zeros(len(a)))


def compare(rows: Rows) -> Iterator[pa.RecordBatch]:
    """Of a tile of a list: links between single vectors; and the balls that others meet, as pairs that other lists can give too."""
    key, low, high = (rows[c][0] for c in ("key", "low", "high"))
    node, weight, slice_, radius, v, near = (rows[c] for c in ("node", "members", "slice", "radius", "v", "near"))
    ball = rows["ball"].astype(bool)
    left, right = (np.arange(len(node)),) * 2 if low == high else (np.flatnonzero(slice_ == low), np.flatnonzero(slice_ == high))

    def later(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x < y if low == high else np.ones(len(x), bool)

    single, others = right[~ball[right]], right[ball[right]]

    def block(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = own[~ball[own]]
        x, y = np.nonzero(v[own] @ v[single].T >= THRESHOLD)
        x, y = own[x], single[y]
        some = later(x, y)
        x, y = x[some], y[some]
        mine = np.ones(len(x), bool)
        for at in range(0, len(x) if near.shape[1] > 1 else 0, 1 << 15):
            p, q = near[x[at : at + (1 << 15)]], near[y[at : at + (1 << 15)]]
            both = np.sort(np.where((p[:, :, None] == q[:, None, :]).any(axis=2), p, np.iinfo(np.int32).max), axis=1)
            mine[at : at + (1 << 15)] = (both[:, 0].astype(np.int64) << 32) + both[:, 1] == key
        return x[mine], y[mine]

    yield from links(node, weight, left, block)
    if not ball.any():
        return
    for own in (left[at : at + SIDE_BY_SIDE] for at in range(0, len(left), SIDE_BY_SIDE)):
        for mine, theirs in ((own[ball[own]], right), (own[~ball[own]], others)):
            if not len(mine) or not len(theirs):
                continue
            apart = angles(v[mine] @ v[theirs].T)
            reach = radius[mine][:, None] + radius[theirs][None, :]
            x, y = np.nonzero(apart - reach <= ANGLE + MARGIN)
            whole = (apart + reach)[x, y] <= ANGLE - MARGIN
            x, y = mine[x], theirs[y]
            some = later(x, y)
            for kind, own_kind in ((WHOLE, some & whole), (PARTLY, some & ~whole)):
                a, b = x[own_kind], y[own_kind]
                if len(a):
                    swap = node[a] > node[b]
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    yield found_rows(kind, node[a], node[b], weight[a], weight[b])


def compare_members(rows: Rows) -> Iterator[pa.RecordBatch]:
    """Links between the members of a ball (on the left) and those of what it meets in part."""
    node, weight, v, host = rows["node"], rows["members"], rows["v"], rows["host"].astype(bool)
    left, right = np.flatnonzero(host), np.flatnonzero(~host)

    def block(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.nonzero(v[own] @ v[right].T >= THRESHOLD)
        return own[x], right[y]

    yield from links(node, weight, left, block)


def sliced(n: str) -> Column:
    return F.ceil(F.col(n) / TILE).cast("int")


def near_links(vectors: DataFrame) -> DataFrame:
    """FOUND rows of vectors (node, v of one length and not zero, members): counts of links, and edges that span them.

    Pairs within a class aren't counted.
    """
    spark = vectors.sparkSession
    pivots = fit(vectors)
    described = settle(describe(vectors, pivots))
    centre = centres(described, pivots)
    size = min(NEAREST, len(pivots))
    rows = settle(balled(described, centre))
    unit = rows.where("ball is not null").groupBy("ball").agg(F.min("node").alias("unit"), F.sum("members").alias("weight"), F.count("*").alias("nodes"), F.max("angle").alias("radius"))
    unit = unit.where("nodes > 1").collect()  # a row a pivot at most
    kind = vectors.schema["v"].dataType.simpleString()
    balls = spark.createDataFrame(
        [(r.ball, r.unit, [float(x) for x in centre[r.ball]], r.weight, r.nodes, r.radius + MARGIN) for r in unit], f"ball int, unit long, centre {kind}, weight long, nodes long, radius double"
    )
    rows = rows.join(F.broadcast(balls.select("ball", "unit")), "ball", "left")
    single = rows.where("unit is null")
    entries = single.select(F.explode(keys(F.col("near"), size)).alias("key"), "node", "v", "members", "near", F.lit(False).alias("ball"), F.lit(0.0).alias("radius"))
    of_ball = rows.where("unit is not null").select("ball", F.explode(keys(F.col("near"), size)).alias("key")).distinct().join(F.broadcast(balls), "ball")
    entries = entries.unionByName(of_ball.select("key", F.col("unit").alias("node"), F.col("centre").alias("v"), F.col("weight").alias("members"), F.array(*[F.lit(-1)] * size).alias("near"), F.lit(True).alias("ball"), "radius"))
    crowd = entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("key", sliced("n").alias("slices"))
    slices = F.coalesce("slices", F.lit(1))
    tiled = (
        entries.join(crowd, "key", "left")
        .withColumn("slice", F.pmod(F.xxhash64("node"), slices).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
        .select("key", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "slice", "node", "v", "members", "near", "ball", "radius")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("key", "low", "high")
    found = settle(tiled.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(tiles(compare), FOUND))
    whole = found.where(F.col("kind") == WHOLE).distinct()
    # What a ball meets in part: of two balls, the one of the greater number is the host.
    of_host = balls.select(F.col("unit").alias("b"), F.lit(True).alias("b_is_ball"))
    partly = found.where(F.col("kind") == PARTLY).select("a", "b").distinct().join(F.broadcast(of_host), "b", "left")
    partly = partly.select(F.when(F.col("b_is_ball"), F.col("b")).otherwise(F.col("a")).alias("key"), F.when(F.col("b_is_ball"), F.col("a")).otherwise(F.col("b")).alias("guest"))
    member = rows.select(F.coalesce("unit", "node").alias("of"), "node", "v", "members")
    guests = partly.join(member, F.col("guest") == F.col("of")).select("key", "node", "v", "members")
    hosts = guests.groupBy("key").agg(F.count("*").alias("n")).join(F.broadcast(balls.select(F.col("unit").alias("key"), "nodes")), "key").select("key", sliced("nodes").alias("lows"), sliced("n").alias("highs"))
    column = lambda x: F.pmod(F.xxhash64("node"), F.col(x)).cast("int")
    each = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    theirs = guests.join(hosts, "key").select("key", each("lows").alias("low"), column("highs").alias("high"), F.lit(False).alias("host"), "node", "v", "members")
    own = member.join(hosts, F.col("of") == F.col("key")).select("key", column("lows").alias("low"), each("highs").alias("high"), F.lit(True).alias("host"), "node", "v", "members")
    inner = own.union(theirs).repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(tiles(compare_members), FOUND)
    # A ball's members are linked with each other and with all of what the ball is linked with.
    of_unit = whole.select(F.col("a").alias("unit"), F.col("m").alias("n")).union(whole.select(F.col("b").alias("unit"), "n")).groupBy("unit").agg(F.sum("n").alias("n"))
    inside = rows.where("unit is not null").join(F.broadcast(balls.select("unit", "weight")), "unit").select("unit", "node", (F.col("weight") - F.col("members")).alias("inner"))
    ball_sums = of_unit.join(F.broadcast(balls.select("unit")), "unit", "left_semi")  # a row a ball at most
    counted = inside.join(F.broadcast(ball_sums), "unit", "left").select(F.col("node").alias("a"), (F.col("inner") + F.coalesce("n", F.lit(0))).alias("n"))
    alone = of_unit.join(balls.select("unit"), "unit", "left_anti").select(F.col("unit").alias("a"), "n")
    edges = whole.select("a", "b").union(inside.where("node <> unit").select("node", "unit"))
    blank = F.lit(None).cast("long")
    return (
        found.where(F.col("kind") <= EDGE)
        .union(inner)
        .union(counted.union(alone).select(F.lit(COUNT).alias("kind"), "a", blank.alias("b"), "n", blank.alias("m")))
        .union(edges.select(F.lit(EDGE).alias("kind"), "a", "b", F.lit(0).cast("long").alias("n"), blank.alias("m")))
    )


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of embeddings.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: they have 0 links, are
    their own component and kept. Vectors of different lengths don't link. Rows are vectors of their own, also where they
    repeat a vec_id or have none: their links are counted by row, and a component is named by its smallest id. Rows of
    one id can be of different components; a row whose component has no id at all has component null and isn't kept. An
    empty table gives none. Columns beside vec_id and embedding aren't read.
    """
    spark = embeddings.sparkSession
    small_batches(spark, 2000)
    v = F.col("embedding")
    if embeddings.schema["embedding"].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, v).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], FOUND)
    for length in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):
        found = found.union(near_links(classes.where(F.size("v") == length)))
    found = settle(found)
    component = connected_components(found.where(F.col("kind") == EDGE).select("a", "b"))
    counts = found.where(F.col("kind") == COUNT).groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    ids = classes.select("node", "rep").join(component, "node")
    ids = met_by(ids, ids.groupBy("component").agg(F.min("rep").alias("least")), "component", "node").select("node", "least")
    labels = (
        classes.join(counts, "node", "left")
        .join(ids, "node", "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    )
    return rows.join(labels, "v", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")), F.lit(False)).alias("kept"),
    )
