"""Vector search: exact nearest neighbours and diversified selection."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Queries of a block; a block's vectors are sent to every task of its pass over the corpus.
LIMIT = 20_000
#: Scores that a task holds at a time: so many queries of a block are multiplied with an Arrow batch at once.
CELLS = 1_000_000


def _rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors of ``dim`` numbers; others are passed over."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    good = np.flatnonzero(lengths == dim)
    flat = pc.list_flatten(column.take(pa.array(good))).to_numpy(zero_copy_only=False).astype(np.float64)
    return good, flat.reshape(len(good), dim)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _best(scores: np.ndarray, turn: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by the smallest ``turn``."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, even = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
        need = k - len(above)
        return np.concatenate([above, even[np.argpartition(turn[even], need - 1)[:need]]])
    return np.arange(len(scores))


def knn(queries: DataFrame, corpus: DataFrame, k: int, key: str = "key", keep: tuple[str, ...] = (), where: Column | None = None, unit: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank, *keep): the ``k`` rows of ``corpus`` with the highest cosine for each query.

    ``queries`` has (query_id, embedding), ``corpus`` (key, embedding, *keep); ``where`` filters the
    corpus before ranking; ``unit`` says that all vectors have length 1. Scores are
    rounded to ``digits``, ties go to the smallest key. Rows whose vector is missing or of
    another length than the query's are not found.

    Each Arrow batch of the corpus is multiplied with all queries at once and passes on its best
    ``k`` of each; the queries go to every task in blocks of LIMIT, one pass over the corpus each.
    """
    chunks = (corpus if where is None else corpus.where(where)).select(F.col(key).alias("key"), "embedding", *(c for c in keep if c != "embedding"))
    asked = queries.where("embedding IS NOT NULL").select(F.to_json(F.struct("query_id")).alias("id"), "embedding")
    some = asked.limit(LIMIT + 1).collect()
    # beyond one block the queries pass through the driver a block at a time
    rest = iter(some) if len(some) <= LIMIT else asked.toLocalIterator()
    schema = chunks.drop("embedding") if "embedding" not in keep else chunks
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    names = schema.columns

    def search(block: list) -> DataFrame:
        by_dim: dict[int, tuple[list[str], np.ndarray]] = {}
        for dim in {len(r["embedding"]) for r in block}:
            own = [r for r in block if len(r["embedding"]) == dim]
            m = np.array([r["embedding"] for r in own], np.float32).astype(np.float64).reshape(len(own), dim)
            by_dim[dim] = ([r["id"] for r in own], m if unit else _unit(m))
        given = corpus.sparkSession.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.select(names)
                turn = np.empty(batch.num_rows, np.int64)
                turn[np.asarray(pc.sort_indices(batch.column("key")))] = np.arange(batch.num_rows)
                for dim, (ids, wanted) in given.value.items():
                    places, m = _rows(batch.column("embedding"), dim)
                    if not len(places):
                        continue
                    m = (m if unit else _unit(m)).T
                    part = max(1, CELLS // len(places))
                    for begin in range(0, len(wanted), part):
                        scores = wanted[begin : begin + part] @ m
                        np.round(scores, digits, out=scores)
                        scores += 0.0
                        best = [_best(s, turn[places], k) for s in scores]
                        at = np.concatenate(best)
                        out = rows.take(pa.array(places[at]))
                        extra = [pa.array(np.repeat(ids[begin : begin + part], [len(b) for b in best]).tolist(), pa.string()), pa.array(np.concatenate([s[b] for s, b in zip(scores, best)]), pa.float64())]
                        yield pa.RecordBatch.from_arrays([*extra, *out.columns], names=["id", "score", *names])

        return chunks.mapInArrow(run, f"id string, score double, {kinds}")

    found = search(list(islice(rest, LIMIT)))
    while block := list(islice(rest, LIMIT)):
        found = found.unionByName(search(block))
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "key")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    query = F.from_json("id", queries.select("query_id").schema)["query_id"].alias("query_id")
    return found.select(query, F.col("key").alias(key), "score", "rank", *keep)


def mmr(queries: DataFrame, corpus: DataFrame, k: int, fetch_k: int, weight: float, key: str = "key", where: Column | None = None, unit: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank): ``k`` of the ``fetch_k`` nearest, picked one at a time.

    Each pick has the highest weight * sim(query, row) - (1 - weight) * max sim(row, picked);
    the first the highest sim. Ties go to the higher sim, then the smaller key. A query's
    candidates, ``fetch_k`` at most, meet in one row.
    """
    return picked(knn(queries, corpus, fetch_k, key, ("embedding",), where, unit, digits), k, weight, key, unit, digits)


def picked(found: DataFrame, k: int, weight: float, key: str = "key", unit: bool = False, digits: int = 6) -> DataFrame:
    """The picks of ``mmr`` among candidates (query_id, key, score, rank, embedding)."""
    near = T.dot if unit else T.cosine
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("score").alias("sim"), F.col(key).alias("key"), "embedding"))).alias("c"))
    rows = rows.select("query_id", "c", F.transform("c", lambda a: F.transform("c", lambda b: F.round(near(a["embedding"], b["embedding"]), digits))).alias("m"))

    def pick(picked: Column, _: Column) -> Column:
        def worth(i: Column) -> Column:
            worst = F.coalesce(F.array_max(F.transform(picked, lambda p: F.get(F.get("m", i), p))), F.lit(0.0))
            return F.round(F.get("c", i)["sim"] * F.lit(weight) - worst * F.lit(1 - weight), digits)

        free = F.filter(F.sequence(F.lit(0), F.size("c") - 1), lambda i: ~F.array_contains(picked, i))
        # the order of the candidates is by sim, then key: the smallest place decides a tie
        best = F.array_max(F.transform(free, lambda i: F.struct(worth(i).alias("w"), (-i).alias("i"))))
        return F.when(F.size(free) == 0, picked).otherwise(F.array_append(picked, -best["i"]))

    picks = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast("array<int>"), pick)
    out = rows.select("query_id", "c", F.posexplode(picks).alias("pos", "i"))
    return out.select("query_id", F.get("c", F.col("i"))["key"].alias(key), F.get("c", F.col("i"))["sim"].alias("score"), (F.col("pos") + 1).alias("rank"))
