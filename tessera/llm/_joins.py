"""Joins whose small side is broadcast only after its rows were counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few dozen bytes; beyond it the join shuffles both sides.
BROADCAST_ROWS = 500_000
#: The same for the bytes of columns of any length.
BROADCAST_BYTES = 64 << 20


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None, wide: tuple[str, ...] = ()) -> DataFrame:
    """``left`` joined with ``right``, which is broadcast if it has at most BROADCAST_ROWS rows, and in its ``wide`` columns, of any length, at most BROADCAST_BYTES.

    ``right`` should be cheap to count (saved or small): it is counted unless ``rows`` is given.
    """
    if wide:
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(0))
        n, total = right.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
        fits = n <= BROADCAST_ROWS and total <= BROADCAST_BYTES
    else:
        fits = (right.limit(BROADCAST_ROWS + 1).count() if rows is None else rows) <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if fits else right, on, how)
