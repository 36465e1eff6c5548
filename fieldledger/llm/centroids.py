"""Centroid clustering by exponion search, in exact integers.

Every vector becomes integers, floor(scale * x), so distances, sums and means are exact and a rerun
gives the same bits. A vector keeps its centroid, an upper bound of its distance to it and a lower bound of its
distance to any other. When the centroids have moved, the bounds are moved with them; where they
still part, nothing is computed. Where they do not, the exact distance to the own centroid is, and
if that does not settle it, the centroids inside the ball around the own one with radius 2 u + s are
scanned: u is the vector's distance, s that of the nearest other centroid. That ball holds the nearest
and the second nearest centroid. Each centroid has the list of all others sorted by distance, so the
ball is a prefix of it. The radius is inclusive and bounds are widened by more than rounding can
take from them, so a tie is always scanned, and goes to the smaller number.

The state is a table in the shared folder, one a round, of which two exist at a time; a lost
executor costs its unfinished tasks. What meets in one place are the centroids, k x dims integers,
and their sums, added up inside each task before they are shuffled: a cluster with most of all vectors is no
more than a few numbers a task. Nothing else is shuffled.

Defined results: vectors that are null, of another width, or with null or non-finite components
are left out; null ids take part, and come last where the first centroids are chosen; rows that repeat an id or
a vector take part each (equal hashes are ordered by components); with fewer than k vectors there are as many centroids; a component so large that
squared distances leave 64 bits is refused with an error; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_table

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Rows that a task works on at a time.
SLICE = 8192
#: Factors that widen and narrow a bound by more than a few roundings of doubles.
UP, DOWN = 1 + 2.0**-40, 1 - 2.0**-40

STATE = "vec_id long, x array<int>, cluster int, upper double, lower double, scanned int"
ASSIGNED = "vec_id long, cluster int, distance long, scanned int"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned int"


def component_limit(dims: int) -> int:
    """Components up to it, in either direction, have squared distances of at most 62 bits."""
    return math.isqrt(2**62 // max(dims, 1)) // 2


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the integer components, of the vectors that take part."""
    finite = F.lit(float("inf"))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < finite))
    )
    fits = F.forall("v", lambda x: F.abs(x * scale) < component_limit(dims))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    return fine.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for squared distances of 64 bits"))).alias("x"))


@dataclass
class Geometry:
    """Centroids with, for each, the others sorted by distance, and how far it has moved."""

    centres: np.ndarray
    moved: np.ndarray
    order: np.ndarray
    gaps: np.ndarray
    others: np.ndarray

    @classmethod
    def of(cls, centres: np.ndarray, before: np.ndarray | None = None) -> "Geometry":
        k = len(centres)
        apart = np.sqrt([squares(centres, c) for c in centres]).reshape(k, k)
        ranked = np.argsort(apart, axis=1, kind="stable")
        order = np.array([[j for j in row if j != i] for i, row in enumerate(ranked)], dtype=int).reshape(k, k - 1)
        moved = np.zeros(k) if before is None else np.sqrt(((centres - before) ** 2).sum(axis=1)) * UP
        # what the farthest mover among the others has moved
        others = np.array([max(np.delete(moved, i), default=0.0) for i in range(k)])
        return cls(centres, moved, order, np.take_along_axis(apart, order, axis=1), others)

    @property
    def nearest(self) -> np.ndarray:
        return self.gaps[:, 0] if self.gaps.shape[1] else np.full(len(self.centres), np.inf)


def squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = x - centre
    return np.einsum("ij,ij->i", apart, apart)


def scan_all(x: np.ndarray, at: Geometry) -> tuple[np.ndarray, ...]:
    """Cluster, bounds, distance and number of distances, from the distances to all centroids."""
    far = np.stack([squares(x, c) for c in at.centres], axis=1)
    cluster = far.argmin(axis=1)
    own = np.take_along_axis(far, cluster[:, None], axis=1)[:, 0]
    if far.shape[1] > 1:
        np.put_along_axis(far, cluster[:, None], np.iinfo(np.int64).max, axis=1)
        lower = np.sqrt(far.min(axis=1)) * DOWN
    else:
        lower = np.full(len(x), np.inf)
    return cluster, np.sqrt(own) * UP, lower, own, np.full(len(x), len(at.centres))


def scan_balls(x: np.ndarray, at: Geometry, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same from the bounds of the last round; the distance is -1 where it was not computed."""
    cluster, upper, lower = cluster.copy(), (upper + at.moved[cluster]) * UP, lower - at.others[cluster]
    distance, scanned = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
    apart = np.maximum(lower, at.nearest[cluster] * (0.5 * DOWN))
    open_ = np.flatnonzero(upper >= apart)
    for a in np.unique(cluster[open_]):
        rows = open_[cluster[open_] == a]
        distance[rows] = own = squares(x[rows], at.centres[a])
        upper[rows] = np.sqrt(own) * UP
        scanned[rows] = 1
        still = upper[rows] >= apart[rows]
        rows, best = rows[still], own[still]
        if not len(rows):
            continue
        number, second = np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
        inside = np.searchsorted(at.gaps[a], (2 * upper[rows] + at.nearest[a]) * UP, side="right")
        for place in range(int(inside.max())):
            j, ask = at.order[a, place], np.flatnonzero(inside > place)
            got = squares(x[rows[ask]], at.centres[j])
            nearer = (got < best[ask]) | ((got == best[ask]) & (j < number[ask]))
            second[ask] = np.minimum(second[ask], np.where(nearer, best[ask], got))
            best[ask], number[ask] = np.where(nearer, got, best[ask]), np.where(nearer, j, number[ask])
        cluster[rows], distance[rows], scanned[rows] = number, best, 1 + inside
        upper[rows], lower[rows] = np.sqrt(best) * UP, np.sqrt(second) * DOWN
    return cluster, upper, lower, distance, scanned


def _matrix(part: pa.RecordBatch, dims: int) -> np.ndarray:
    return part["x"].flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _assign(at: Geometry, last: bool):
    """A round over a task's rows: their new state, or in the last round their distances."""
    dims = at.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            x = _matrix(part, dims)
            if "cluster" in part.schema.names:
                before = part["scanned"].to_numpy()
                cluster, upper, lower, distance, scanned = scan_balls(x, at, part["cluster"].to_numpy(), part["upper"].to_numpy(), part["lower"].to_numpy())
                scanned = scanned + before
            else:
                cluster, upper, lower, distance, scanned = scan_all(x, at)
            number, count = pa.array(cluster.astype(np.int32)), pa.array(scanned.astype(np.int32))
            if last:
                for a in np.unique(cluster[distance < 0]):
                    rows = np.flatnonzero((cluster == a) & (distance < 0))
                    distance[rows] = squares(x[rows], at.centres[a])
                yield pa.RecordBatch.from_arrays([part["vec_id"], number, pa.array(distance), count], ["vec_id", "cluster", "distance", "scanned"])
            else:
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["x"], number, pa.array(upper), pa.array(lower), count], ["vec_id", "x", "cluster", "upper", "lower", "scanned"])

    return run


def _sums(k: int, dims: int):
    """A task's sums: one row for each of its clusters and components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for part in _slices(batches):
            x, cluster = _matrix(part, dims), part["cluster"].to_numpy()
            for a in np.unique(cluster):
                rows = cluster == a
                total[a] += x[rows].sum(axis=0)
                n[a] += rows.sum()
        seen = np.flatnonzero(n)
        columns = np.repeat(seen, dims), np.tile(np.arange(dims), len(seen)), total[seen].ravel(), np.repeat(n[seen], dims)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cluster", "place", "total", "n"])

    return run


def first_centroids(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest hashes of ``seed:vec_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(F.asc_nulls_last(digest), "x").limit(k).select("x").collect()  # k rows
    return np.array([r["x"] for r in chosen], np.int64)


def next_centroids(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster's vectors; empty clusters keep their centroid."""
    sums = state.select("cluster", "x").mapInArrow(_sums(*centres.shape), "cluster long, place long, total long, n long")
    out = centres.copy()
    for row in sums.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k x dims rows
        out[row["cluster"], row["place"]] = row["total"] // row["n"]
    return out


def centroid_digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, and scanned:
    how many distances were computed for the vector to place it, over all rounds."""
    spark = vectors.sparkSession
    state = shared_table(integer_vectors(vectors, dims, scale), "centroids-vectors")
    centres = first_centroids(state, k, seed)
    if not len(centres):
        return spark.createDataFrame([], RESULT)
    geometry = Geometry.of(centres)
    for _ in range(rounds):
        moved = shared_table(state.mapInArrow(_assign(geometry, False), STATE), "centroids-state")
        discard(state)
        state = moved
        centres, before = next_centroids(state, centres), centres
        geometry = Geometry.of(centres, before)
    found = shared_table(state.mapInArrow(_assign(geometry, True), ASSIGNED), "centroids-found")
    discard(state)
    inertia = {r["cluster"]: r["i"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}  # k rows
    facts = [(a, i, sum(inertia.values()), centroid_digest(centres[a])) for a, i in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
