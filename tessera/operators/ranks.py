"""Exact nearest-rank percentiles by narrowing ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.small import small
from tessera.sources.scratch import saved

#: Values up to which a range is looked at one by one; ranges that a larger one is cut into.
FEW, CUTS = 100_000, 4096
#: Ranges to the natural logarithm in the first pass, and the place of values beyond all numbers.
_FINE, _END = 64, 1 << 40


def _first_cut(v: Column) -> Column:
    """A range by sign and logarithm: rising with the value, infinite and NaN at the ends."""
    finite = F.floor(F.signum(v) * F.log1p(F.abs(v)) * _FINE)
    return F.when(F.isnan(v), F.lit(_END + 1)).when(v == float("inf"), F.lit(_END)).when(v == float("-inf"), F.lit(-_END)).otherwise(finite).cast("bigint")


def _even_cut(v: Column) -> Column:
    """A range of equal widths between lo and hi, rising with the value."""
    lo, hi = F.col("lo"), F.col("hi")
    # halves where the difference of two doubles is beyond all doubles
    part = F.when(hi - lo < float("inf"), F.try_divide(v - lo, hi - lo)).otherwise(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2))
    return F.least(F.lit(CUTS - 1), F.floor(part * CUTS)).cast("bigint")


def nearest_ranks(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., a column for each share): the sorted values' element at floor(n * share), the last at most (0-based).

    Without ``by`` there is one row, of nulls if there is no value; groups without a value are left out. NaN counts as the highest value.

    A pass counts the values by ranges; of these only the one that holds the rank goes on, with the rank in it, and is cut
    again until it has few values or one distinct one, which are then looked at. So what is shuffled is counts of
    ranges, and no task sees more than one range's values.
    """
    own = rows.where(F.col(value).isNotNull()).select(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), (F.col(value).cast("double") + F.lit(0.0)).alias("v"))
    keys = [f"_b{i}" for i in range(len(by))]
    counted = [F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    first = own.groupBy(*keys, _first_cut(F.col("v")).alias("cut")).agg(*counted)
    first = saved(first)
    if keys:
        first = first.withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    else:
        first = first.withColumn("n", F.lit(first.agg(F.sum("c")).first()[0]).cast("bigint"))
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("share"), F.lit(float(p)).alias("p")) for n, p in shares.items()))).alias("s")
    named = first.select("*", wanted).select(*keys, F.col("s.share").alias("share"), F.least(F.floor(F.col("n") * F.col("s.p")), F.col("n") - 1).alias("rank"), "cut", "c", "lo", "hi")
    now = saved(_holding(named, keys))
    while not (open_ := now.where((F.col("c") > FEW) & (F.col("lo") < F.col("hi")))).isEmpty():
        cut = _within(own, open_, keys).groupBy(*keys, "share", "rank", _even_cut(F.col("v")).alias("cut")).agg(*counted)
        now = saved(now.where((F.col("c") <= FEW) | (F.col("lo") >= F.col("hi"))).unionByName(_holding(cut, keys)))
    told = now.where("lo >= hi").select(*keys, "share", F.col("lo").alias("v"))
    left = now.where("lo < hi")
    if not left.isEmpty():
        each = _within(own, left, keys).groupBy(*keys, "share", "rank", "v").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        told = told.unionByName(_holding(each.withColumn("cut", F.col("v")), keys).select(*keys, "share", F.col("lo").alias("v")))
    picks = [F.max(F.when(F.col("share") == n, F.col("v"))).alias(n) for n in shares]
    return told.groupBy(*(F.col(k).alias(b) for k, b in zip(keys, by))).agg(*picks) if by else told.agg(*picks)


def _holding(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Of the ranges (keys, share, rank, cut, c, lo, hi) the one that holds the rank, with the rank in it."""
    order = Window.partitionBy(*keys, "share").orderBy("cut")
    upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = cuts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    return held.select(*keys, "share", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "c", "lo", "hi")


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, share, rank, lo, hi, v) of the values within each range."""
    same = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for k in keys:
        same = same & rows[k].eqNullSafe(ranges[k])
    return rows.join(small(ranges), same).select(*(rows[k] for k in keys), "share", "rank", "lo", "hi", "v")
