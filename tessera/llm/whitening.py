"""Whitening of embeddings by Chan's merging of partial covariances.

Each partition counts its vectors and makes their mean and centred scatter; two such parts merge by

    scatter = scatter1 + scatter2 + n1 * n2 / (n1 + n2) * d * transposed(d),   d = mean1 - mean2

in a tree over the executors, so neither a sum of squares that dwarfs the variance nor any list of
vectors is ever formed; the driver gets one matrix. Entries are whole numbers (see ``scaled``), so counts and
sums are exact, and means come from them. The driver decomposes the covariance; a second pass over the
vectors measures how far the whitened ones are from unit covariance.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
#: Entries beyond it count as it.
LIMIT = 1 << 46
#: Rows of a partition that are centred and multiplied at a time.
_BLOCK = 8192
#: A component with less than this share of the largest variance is rounding noise.
_NOISE = 1e-12

Part = tuple[int, np.ndarray, np.ndarray]


def usable(vector: str) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) + 100000 as whole numbers; values beyond 2**46 count as that."""
    return np.clip(np.floor(SCALE * x.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64) + OFFSET


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, size)


def _exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums of whole numbers as Python's numbers, so none overflows at any size."""
    high, low = x >> 24, x & ((1 << 24) - 1)
    return high.sum(axis=0).astype(object) * (1 << 24) + low.sum(axis=0).astype(object)


def merge(a: Part, b: Part) -> Part:
    """Chan's formula for (count, exact sums, centred scatter) of two disjoint parts."""
    (n, s, m), (k, t, w) = a, b
    if not n or not k:
        return a if n else b
    # the difference of the means over whole numbers: (s * k - t * n) / (n * k)
    d = np.array([x / (n * k) for x in s * k - t * n], np.float64)
    return n + k, s + t, m + w + (n * k / (n + k)) * np.outer(d, d)


def _part(x: np.ndarray) -> Part:
    """Count, exact sums and scatter of the rows of ``x`` (whole numbers or doubles), centred before multiplying."""
    if x.dtype == np.int64:
        sums = _exact_sum(x)
        # centred on a whole number first: what is left is small, and its mean loses no digit
        pivot = np.array([int(v) // len(x) for v in sums], np.int64)
        c = (x - pivot).astype(np.float64)
    else:
        sums, c = np.array(x.sum(axis=0), object), x
    c = c - c.mean(axis=0)
    return len(x), sums, c.T @ c


def _merged(rows: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], wide: int) -> Part:
    """The merged part of what ``of`` makes of a batch's vectors (``wide`` numbers each). Partials meet in a tree on the executors."""
    zero = (0, np.zeros(wide, object), np.zeros((wide, wide)))

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zero
        for batch in batches:
            x = of(_vectors(batch.column(0), size))
            for begin in range(0, len(x), _BLOCK):
                own = merge(own, _part(x[begin : begin + _BLOCK]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["part"])

    def loaded(row) -> Part:
        return pickle.loads(row["part"])

    parts = rows.mapInArrow(partition, "part binary").rdd.map(loaded)
    n = parts.getNumPartitions()
    return parts.treeReduce(merge, depth=max(2, math.ceil(math.log(n, 16)))) if n else zero


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: ``n`` vectors, their exact sums, and of each component its direction (a row) and variance."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - mean, from n * x - sums, which are whole numbers."""
        if self._bound(x) < 2**63:
            return (x * self.n - self.sums.astype(np.int64)) / self.n
        return np.array([[v / self.n for v in row] for row in x.astype(object) * self.n - self.sums], np.float64).reshape(x.shape)

    def _bound(self, x: np.ndarray) -> int:
        return self.n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in self.sums), default=0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The centred vectors along each component, in units of its standard deviation."""
        return self.centred(x) @ (self.directions / np.sqrt(self.variances)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sums) ** 2, exact; none where it is no 64-bit number."""
        if self._bound(x) < 2**63:
            d = x * self.n - self.sums.astype(np.int64)
            if x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 2**63:
                return (d * d).sum(axis=1).tolist()
        exact = (int((row * row).sum()) for row in x.astype(object) * self.n - self.sums)
        return [v if v < 2**63 else None for v in exact]


def fit(vectors: DataFrame, vector: str = "embedding", components: int | None = None) -> tuple[Whitening, int]:
    """The whitening of all usable vectors, and their length; at most ``components`` of the largest variance.

    One length counts, the most frequent (of equally frequent ones the larger). Components whose variance is rounding
    noise against the largest are left out, so fewer vectors than dimensions, or equal ones, give fewer components;
    each direction's largest entry is positive.
    """
    rows = vectors.where(usable(vector))
    common = rows.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = common["size"] if common else 0
    n, sums, scatter = _merged(rows.where(F.size(vector) == size).select(F.col(vector).cast("array<double>")), size, scaled, size) if size else (0, np.zeros(0, object), np.zeros((0, 0)))
    if not n:
        return Whitening(0, sums, np.zeros((0, size)), np.zeros(0), 0.0), size
    values, directions = np.linalg.eigh(scatter / n)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > _NOISE * max(values.max(), 0.0)][: components or size]
    directions = directions.T[order]
    signs = np.sign(directions[np.arange(len(order)), np.abs(directions).argmax(axis=1)]) if len(order) else np.zeros(0)
    return Whitening(n, sums, directions * signs[:, None], values[order], float(np.trace(scatter) / n)), size


def identity_error(vectors: DataFrame, model: Whitening, size: int, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, by a pass over all of them."""
    k = len(model.variances)
    if not k:
        return 0.0
    rows = vectors.where(usable(vector) & (F.size(vector) == size)).select(F.col(vector).cast("array<double>"))
    n, _, scatter = _merged(rows, size, lambda x: model.whitened(scaled(x)), k)
    return float(np.abs(scatter / n - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int | None = 8) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error) for each usable vector.

    whitened and explained are arrays, one entry a component, by falling variance; explained is the component's
    share of the whole variance. n and identity_error are of the fit and the same in every row. deviation is the sum of
    (n * x - sums) ** 2 over the dimensions, null where it is no 64-bit number.

    Vectors that are null, empty or hold a null or a value that is not finite are dropped, as are those of another length than the most frequent one.
    Repeated rows and rows without a key count and are returned each; equal variances (ties) are in the order of the decomposition;
    without a vector there is no row, and where all vectors are equal the arrays are empty. Other columns aren't read.
    """
    model, size = fit(vectors, vector, components)
    error = identity_error(vectors, model, size, vector)
    kind = vectors.schema[key].dataType.simpleString()
    given = vectors.sparkSession.sparkContext.broadcast(model)
    explained = (model.variances / model.total).tolist() if model.total else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(_vectors(batch.column(1), size))
            y = given.value.whitened(x)
            k = y.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(y.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(given.value.deviations(x), pa.int64()), lists], names=["key", "deviation", "whitened"])

    rows = vectors.where(usable(vector) & (F.size(vector) == size)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    found = rows.mapInArrow(run, f"key {kind}, deviation bigint, whitened array<double>")
    return found.select(F.col("key").alias(key), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
