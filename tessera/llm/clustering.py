"""Clustering of vectors around centroids by annulus search.

The centroids are sorted by their norm. By the triangle inequality a centroid within distance u of a
vector has a norm within u of the vector's, so with an upper bound u of the distance to the nearest centroid
(here: the nearer of the two centroids next to the vector's norm) only those in that annulus, found by two binary
searches, can be nearest. They are compared exactly, over whole numbers, boundaries included; of equally near
ones the smallest number counts. Vectors are taken in the order of their norms, so that neighbours share an annulus and
are compared by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._storage import saved
from tessera.llm.whitening import usable

CLUSTERS, ROUNDS, SCALE, SEED = 40, 5, 256, 2
#: Components beyond it count as it, so that squared distances of up to 512 components fit a 64-bit number.
LIMIT = 1 << 26
#: Vectors that are compared with their common annulus at a time.
_BLOCK = 512
#: Up to this size products and sums of a vector's components are exact as doubles.
_EXACT = 2**53


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    return np.clip(np.floor(scale * x.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


class Annulus:
    """Centroids (whole numbers, a row each) sorted by norm, for exact search."""

    def __init__(self, centroids: np.ndarray) -> None:
        squares = (centroids * centroids).sum(axis=1)
        self.number = np.argsort(squares, kind="stable")
        self.centroids, self.squares = centroids[self.number], squares[self.number]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.largest = int(np.abs(centroids).max(initial=0))

    def _squared(self, x: np.ndarray, squares: np.ndarray, some: slice | np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of ``x`` to some centroids: to all of a slice, or each to its own."""
        c, largest = self.centroids[some], max(self.largest, int(np.abs(x).max(initial=0)))
        if isinstance(some, slice):
            exact = x.shape[1] * largest * largest < _EXACT
            product = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if exact else x @ c.T
            return squares[:, None] + self.squares[some][None, :] - 2 * product
        return squares + self.squares[some] - 2 * (x * c).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of ``x``."""
        squares = (x * x).sum(axis=1)
        order = np.argsort(squares, kind="stable")
        x, squares = x[order], squares[order]
        norm = np.sqrt(squares.astype(np.float64))
        last = len(self.norms) - 1
        at = np.searchsorted(self.norms, norm)
        bound = np.minimum(self._squared(x, squares, np.minimum(at, last)), self._squared(x, squares, np.maximum(at - 1, 0)))
        # a little wider than the bound: square roots are rounded, and a centroid on the edge may tie
        reach = np.sqrt(bound.astype(np.float64)) * (1 + 1e-9) + (norm + self.norms[-1]) * 1e-12 + 1e-9
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        number, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for begin in range(0, len(x), _BLOCK):
            rows = slice(begin, begin + _BLOCK)
            some = slice(int(low[rows].min()), int(high[rows].max()))
            found = self._squared(x[rows], squares[rows], some)
            distance[rows] = least = found.min(axis=1)
            number[rows] = np.where(found == least[:, None], self.number[some][None, :], len(self.norms)).min(axis=1)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return number[back], distance[back]


def _matrix(column: pa.Array, size: int, scale: int) -> np.ndarray:
    return whole(pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, size), scale)


def start(rows: DataFrame, key: str, vector: str, clusters: int, seed: int, scale: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:key``, in that order; equal ones by their components, those without a key last."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    first = rows.orderBy(place.asc_nulls_last(), vector).select(vector).limit(clusters).collect()
    return whole(np.array([r[0] for r in first], np.float64), scale)


def _moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The floor of each centroid's mean vector; centroids without a vector stay. Each task sends one sum a centroid and component."""
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, n = Annulus(centroids), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), size, scale)
            number, _ = search.nearest(x)
            order = np.argsort(number, kind="stable")
            own, begins, counts = np.unique(number[order], return_index=True, return_counts=True)
            if len(own):
                total[own] += np.add.reduceat(x[order], begins)
                n[own] += counts
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, size + 1), pa.int32()), pa.array(np.tile(np.arange(size + 1), len(some)), pa.int32()), pa.array(np.concatenate([total[some], n[some, None]], axis=1).ravel(), pa.int64())],
            names=["cluster", "place", "total"],
        )

    # decimal: sums of all rows may need more than 64 bits
    found = rows.mapInArrow(sums, "cluster int, place int, total bigint").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums_of = {(r["cluster"], r["place"]): int(r["total"]) for r in found}
    moved = centroids.copy()
    for c in {c for c, _ in sums_of}:
        moved[c] = [sums_of[c, i] // sums_of[c, size] for i in range(size)]
    return moved


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = 64, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) for each vector of ``size`` finite components.

    Components become floor(scale * x). ``rounds`` times every vector goes to its nearest centroid by squared Euclidean
    distance, and each centroid to the floor of its vectors' mean; then each vector is assigned once more. centroid is the
    cluster's final one, the inertias are the sums of distance over the cluster and over all.

    Vectors that are null, of another length, or hold a null or a value that is not finite are left out; components beyond 2**26 after scaling count as that.
    Ties go to the smaller number; repeated rows and rows without a key are clustered each; with fewer vectors than ``clusters`` there are
    as many centroids as vectors; without a vector there is no row. Other columns aren't read. The driver holds the centroids only.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.where(usable(vector) & (F.size(vector) == size)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    centroids = start(rows, "key", "x", clusters, seed, scale).reshape(-1, size)
    result = f"key {kind}, cluster int, distance bigint"
    if not len(centroids):
        found = rows.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    else:
        for _ in range(rounds):
            centroids = _moved(rows.select("x"), centroids, scale)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Annulus(centroids)
            for batch in batches:
                number, distance = search.nearest(_matrix(batch.column(1), size, scale))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["key", "cluster", "distance"])

        found = saved(rows.mapInArrow(assign, result))
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    own = [(c, sums[c], sum(sums.values()), centroids[c].tolist()) for c in sorted(sums)]
    told = vectors.sparkSession.createDataFrame(own, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return found.join(F.broadcast(told), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


