"""Running totals over an order that spans partitions, in two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.small import small
from tessera.sources.scratch import saved


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, place: str | None = None) -> DataFrame:
    """``rows`` with the running total of each of ``sums`` (name to value) within ``by``, and as ``place`` the row's number from 1, by ``order``.

    The rows are dealt out by ranges of by and order and kept so; each range adds up what it has of each group, the
    totals of the ranges before it are added on, and each range counts on from there. So a task holds a range, however
    many rows a group has. A null value adds nothing; rows that ``order`` leaves equal are in one range, in any order.
    """
    values = dict(sums or {}) | ({place: F.lit(1).cast("bigint")} if place else {})
    held = rows.select("*", *(v.alias(f"_v_{n}") for n, v in values.items())).repartitionByRange(*by, *order)
    held = saved(held).withColumn("_range", F.spark_partition_id())
    parts = held.groupBy("_range", *by).agg(*(F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(f"_t_{n}") for n in values))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values)
    parts = parts.select(F.col("_range").alias("_of"), *(F.col(b).alias(f"_b_{i}") for i, b in enumerate(by)), *offsets)
    same = F.col("_range") == F.col("_of")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b_{i}"))
    # as many rows as ranges and groups: a range's rows of a group meet one of them
    both = held.join(small(parts), same)
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), *((F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0))).alias(n) for n in values))
