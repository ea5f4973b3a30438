"""Bounded samples of keyed rows: those with the smallest hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANGE = 1 << 62
#: A first cut by the hash lets this many times the wanted rows through, so few rows are sorted whatever the input's size.
_SPARE = 4


def place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_RANGE))


def smallest(rows: DataFrame, key: str, most: int, group: str) -> DataFrame:
    """``most`` rows of each ``group`` at most; the groups, few by nature, are counted first.

    ``key`` has no null and names one row of its group: the first cut counts on that.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    near = rows.join(F.broadcast(counts), group) if counts.limit(100_001).count() <= 100_000 else rows.join(counts, group)
    near = near.where(place(key) <= F.lit(float(_RANGE)) * F.least(F.lit(1.0), F.lit(float(_SPARE * most)) / F.col("_n")))
    order = Window.partitionBy(group).orderBy(place(key), key)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_n", "_r")
