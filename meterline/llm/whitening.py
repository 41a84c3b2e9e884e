"""Whitening of embeddings (operator 13): Welford's updates, merged by the parallel formula, and a symmetric QR eigen-solve.

Each partition's iterator updates a mean and a matrix of centred products by one rank-one update a vector. The states of
the partitions are merged, FAN_IN at a time and round by round, with Chan's formula for two sets of observations. What is
left is one state a length of vectors, whose covariance is brought to tridiagonal form by Householder reflections and
solved by implicitly shifted QR steps in the driver: length x length numbers, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
FAN_IN = 32
#: Entries of this size or more have no exact whole number to be counted in; their rows are dropped like non-finite ones.
TOO_LARGE = 2.0**38
#: Components of a smaller share of the largest eigenvalue have no variance that double precision can tell from none.
LEAST_SHARE = 1e-13
#: So many numbers of covariances at most are held in the driver, over all lengths of vectors; more is an error.
MOST_NUMBERS = 1 << 26


class State(NamedTuple):
    """n observations with their exact sums, mean and sum of centred products."""

    n: int
    total: list[int]
    mean: np.ndarray
    products: np.ndarray

    def merged(self, other: State) -> State:
        n, apart = self.n + other.n, other.mean - self.mean
        products = self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n)
        return State(n, [a + b for a, b in zip(self.total, other.total)], self.mean + apart * (other.n / n), products)


class Welford:
    """One rank-one update a vector."""

    def __init__(self, length: int) -> None:
        self.n, self.total, self.mean, self.products = 0, [0] * length, np.zeros(length), np.zeros((length, length))

    def update(self, rows: np.ndarray) -> None:
        mean, products = self.mean, self.products
        for row in rows.astype(float):
            self.n += 1
            before = row - mean
            mean += before / self.n
            products += np.multiply.outer(before, row - mean)
        if rows.dtype == np.int64:
            self.total = [a + b for a, b in zip(self.total, rows.sum(axis=0).tolist())]


def whole(rows: np.ndarray) -> np.ndarray:
    return np.floor(rows * SCALE).astype(np.int64) + OFFSET


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of the lists of a column."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == length)
        own = column if len(at) == len(column) else column.take(pa.array(at))
        yield int(length), at, own.flatten().to_numpy(zero_copy_only=False).reshape(-1, int(length))


STATE = "length int, place long, n long, total array<decimal(38,0)>, mean binary, products binary"


def state_rows(states: list[tuple[int, int, State]]) -> pa.RecordBatch:
    decimal = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in states], pa.int32()),
            pa.array([x[1] for x in states], pa.int64()),
            pa.array([x[2].n for x in states], pa.int64()),
            pa.array([[pa.scalar(v, pa.int64()).cast(decimal).as_py() if abs(v) < 1 << 62 else v for v in x[2].total] for x in states], pa.list_(decimal)),
            pa.array([x[2].mean.tobytes() for x in states], pa.binary()),
            pa.array([x[2].products.tobytes() for x in states], pa.binary()),
        ],
        ["length", "place", "n", "total", "mean", "products"],
    )


def state_of(row: dict) -> State:
    mean = np.frombuffer(row["mean"])
    return State(row["n"], [int(x) for x in row["total"]], mean, np.frombuffer(row["products"]).reshape(len(mean), -1))


def moments(vectors: DataFrame, of: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, State]:
    """The state of each length of vectors (v), after `of` has turned their rows into observations."""

    def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Welford] = {}
        for batch in batches:
            for length, _, rows in by_length(batch.column("v")):
                seen = of(length, rows)
                if seen.shape[1]:
                    own.setdefault(length, Welford(seen.shape[1])).update(seen)
        if own:
            place = TaskContext.get().partitionId()
            yield state_rows([(length, place, State(x.n, x.total, x.mean, x.products)) for length, x in own.items()])

    def joined(rows: pa.Table) -> pa.Table:
        first, *rest = sorted(rows.to_pylist(), key=lambda r: r["place"])
        state = state_of(first)
        for row in rest:
            state = state.merged(state_of(row))
        return pa.Table.from_batches([state_rows([(first["length"], first["place"] // FAN_IN, state)])])

    states = settle(vectors.select("v").mapInArrow(observed, STATE))
    while (states.agg(F.max("place")).first()[0] or 0) > 0:
        states = settle(states.groupBy("length", F.floor(F.col("place") / FAN_IN)).applyInArrow(joined, STATE))
    numbers = sum(r[0] ** 2 for r in states.select("length").toLocalIterator())
    if numbers > MOST_NUMBERS:
        raise ValueError(f"the covariances of all lengths of vectors have {numbers} numbers, more than {MOST_NUMBERS}")
    return {r["length"]: state_of(r.asDict()) for r in states.collect()}


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) with Q.T @ tridiagonal @ Q = matrix, by Householder reflections."""
    a, n = matrix.copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[k + 1 :, :] -= 2 * np.outer(x, x @ q[k + 1 :, :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as rows) of a symmetric matrix, by QR steps with Wilkinson's shift.

    A step chases a bulge down the unreduced block that ends lowest; an off-diagonal entry that is nothing beside its
    neighbours splits the block.
    """
    d, e, rows = tridiagonal((matrix + matrix.T) / 2)
    tiny, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        if small[hi - 1]:
            e[hi - 1], hi = 0, hi - 1
            continue
        lo = int(np.flatnonzero(small)[-1]) + 1 if small.any() else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, q, o = d[k], d[k + 1], e[k]
            d[k] = c * c * p + 2 * c * s * o + s * s * q
            d[k + 1] = s * s * p - 2 * c * s * o + c * c * q
            e[k] = c * s * (q - p) + (c * c - s * s) * o
            x = e[k]
            if k < hi - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            rows[k], rows[k + 1] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    order = np.argsort(-d, kind="stable")
    return d[order], rows[order]


class Fit(NamedTuple):
    """What whitens the vectors of one length."""

    n: int
    total: list[int]
    axes: np.ndarray  # a component a column, over the root of its eigenvalue
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: exact, as int64 where all fit, else as Python's whole numbers."""
        if float(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.total), default=0) < 2.0**62:
            return self.n * x - np.array(self.total, np.int64)
        return self.n * x.astype(object) - np.array(self.total, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.axes


def deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; None where one doesn't fit a long."""
    if centred.dtype != object and float(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 2.0**62:
        return (centred * centred).sum(axis=1).tolist()
    squares = (centred.astype(object) ** 2).sum(axis=1).tolist()
    return [x if x < 1 << 63 else None for x in squares]


def fitted(state: State, components: int) -> Fit:
    covariance = state.products / state.n
    values, vectors = symmetric_qr(covariance)
    keep = values[:components] > max(values[0] * LEAST_SHARE, 0)
    values, vectors = values[:components][keep], vectors[:components][keep]
    return Fit(state.n, state.total, (vectors / np.sqrt(values)[:, None]).T.copy(), values / (np.trace(covariance) or 1.0))


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each sound row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries or entries of TOO_LARGE or more are dropped.
    Vectors of each length are a list of their own, with its own n, sums, components and identity_error. Components whose
    eigenvalue can't be told from 0 (all of them, for a single vector or equal ones) can't be whitened and have no rows;
    components of equal eigenvalues are in any order. deviation is null where it doesn't fit a long. Repeated rows and
    null ids are rows. An empty table gives none. Columns beside vec_id and embedding aren't read.
    """
    spark = embeddings.sparkSession
    small_batches(spark, 2000)
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < TOO_LARGE))  # NaN is more than any number
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(sound & (F.size("v") > 0))
    fits = {length: fitted(state, components) for length, state in moments(rows, lambda _, x: whole(x)).items()}
    shared = spark.sparkContext.broadcast(fits)
    white = moments(rows, lambda length, x: shared.value[length].whitened(shared.value[length].centred(whole(x))))
    errors = {length: float(np.abs(s.products / s.n - np.eye(len(s.mean))).max()) for length, s in white.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at, found in by_length(batch.column("v")):
                fit = shared.value[length]
                k, centred = len(fit.explained), fit.centred(whole(found))
                if not k:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(k * len(at), fit.n, np.int64)),
                        pa.array(deviations(centred), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        pa.array(fit.whitened(centred).ravel()),
                        pa.array(np.tile(fit.explained, len(at))),
                        pa.array(np.full(k * len(at), errors[length])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, WHITE)
