"""Dealing documents out into groups of bounded size, and counting hashes between groups.

A group holds a few MB of whole documents. For a count over all documents each group sends
its *distinct* hashes, packed, to buckets of the hash range, and gets its answer back packed
in the order sent. So a hash that a third of all documents have reaches its bucket once a
group, and no text moves after it was dealt out. Empty packets aren't sent: packets are never
more than the distinct hashes of the groups, which grow with the input, not with its square.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]


def give_back() -> None:
    """Return freed memory of a Python worker to the machine; idle workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def group_size(total: int, least: int, most: int = 32 << 20) -> int:
    """Bytes of a group: more where there are many groups, so that what a group sends to a bucket doesn't become a few bytes."""
    return max(least, min(most, total // 20_000))


def loosened(kind: T.StructType) -> T.StructType:
    """The type with everything nullable, as what comes back from Arrow is."""

    def walk(x):
        if isinstance(x, dict):
            return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    return T.StructType.fromJson(walk(kind.jsonValue()))


def dealt(docs: DataFrame, text: str, total: int, group_bytes: int, spread: Iterable[Column]) -> DataFrame:
    """(g, text binary, row struct of the other columns): g deals the rows to groups of about ``group_bytes``."""
    groups = max(1, math.ceil(total / group_bytes))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    row = F.struct(*others)
    kind = loosened(docs.select(row.alias("row")).schema["row"].dataType)
    return docs.select(
        F.pmod(F.xxhash64(*spread, F.col(text)), F.lit(groups)).cast("int").alias("g"),
        F.col(text).cast("binary").alias("text"),
        row.cast(kind).alias("row"),
    )


def in_order(table: pa.Table) -> tuple[pa.Table, list[bytes | None]]:
    """The group's rows in the order of their texts (the same in every pass), and the texts."""
    texts = table.column("text").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (texts[i] is not None, texts[i] or b""))
    return table.take(pa.array(order, pa.int64())), [texts[i] for i in order]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of each hash; sorted hashes have sorted buckets."""
    return (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def packed(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted hashes."""
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), slice(int(cuts[b]), int(cuts[b + 1]))


def low_bytes(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_low_bytes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each sorted entry, first entry of each group) of equal keys; the first key leads."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)
