"""Embedding each distinct chunk once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sync import first_by

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic vectors of unit length from hashed words; a stand-in where no model is at hand, not one."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1.0 if h >> 63 else -1.0
            n = float(np.linalg.norm(row))
            row[:] = row / n if n else 0
            if not n:
                row[0] = 1.0
        return out.tolist()

    return embed


def dedup_key(hash_column: str, *row_id: str) -> Column:
    """The chunk's hash; without one a key of its own, that no other row shares."""
    own = F.concat_ws(":", F.lit("__no_hash__"), *(F.col(c).cast("string") for c in row_id))
    return F.coalesce(F.nullif(F.col(hash_column), F.lit("")), own)


def embed_distinct(chunks: DataFrame, embedder: Embedder, batch: int = 100, hash_column: str = "chunk_content_hash", row_id: tuple[str, ...] = ("source", "chunk_index"), text: str = "page_content") -> DataFrame:
    """``chunks`` with ``embedding``; chunks of one hash share the vector of the first of them by ``row_id``.

    The model sees each distinct chunk once, in batches of ``batch``; an error in it fails the job.
    """

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            values = texts.fillna("").tolist()
            yield pd.Series([v for at in range(0, len(values), batch) for v in embedder(values[at : at + batch])], index=texts.index, dtype=object)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    model = F.pandas_udf(run, "array<float>")
    keyed = chunks.withColumn("_key", dedup_key(hash_column, *row_id))
    once = first_by(keyed.select("_key", F.col(text).alias("_text"), *row_id), ["_key"], list(row_id))
    vectors = once.select("_key", model("_text").alias("embedding"))
    return keyed.join(vectors, "_key").drop("_key")
