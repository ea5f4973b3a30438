"""Connected components of an edge table: each part's edges in its task, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._exchange import give_back
from tessera.llm._storage import saved

#: Edges that one task joins to trees.
_EDGES_A_PART = 100_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers 0 to n - 1 that each of them reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        if np.array_equal(x, y):
            return root
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(up := root[root], root):
            root = up


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for each node of a part's edges: b is the smallest node that a reaches within the part."""
    if not (batches := list(batches)):
        return
    both = pa.concat_arrays([x.column(i) for i in (0, 1) for x in batches]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    a, b = rank[both.indices.to_numpy()].reshape(2, -1)
    nodes = both.dictionary.take(pa.array(order))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(_roots(a, b, len(order))))], names=["a", "b"])
    give_back()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Edges from a node to itself count for nothing. The edges are dealt to parts of about
    ``_EDGES_A_PART``, and a task joins those of its part to trees; that is done again as long as it
    leaves edges for fewer parts, and a single part is the result. Else stars join the trees: the
    number of rounds grows with the logarithm of the longest path; each round's edges are written to the
    shared folder, so that a lost executor costs one round at most. Only row counts and a checksum
    come to the driver.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    kind = now.schema["a"].dataType.simpleString()
    parts, fewer = None, max(1, -(-now.count() // _EDGES_A_PART))
    while parts is None or fewer < parts:
        parts = fewer
        trees = saved(now.coalesce(parts).mapInArrow(_trees, f"a {kind}, b {kind}"))
        if parts == 1:
            return trees.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = trees.where("a <> b")
        fewer = -(-now.count() // _EDGES_A_PART)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first()
        if seen == mark:
            break
        mark = seen
        # few edges in few files: each round writes as many as it has partitions
        now = saved(_small_star(_large_star(now)).coalesce(-(-seen[0] // _EDGES_A_PART)))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
