"""Ranks and running sums over a whole table, without a window of one partition.

Rows are dealt to ranges of their order by bounds that are literals of the plan.
So however often, and in however many stages, the plan is evaluated, a row's range
is the same; ranges' totals are a window of one row a range, and a range's rows are
summed in a window of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled values that stand for a range; ranges differ in size by about one part in its root.
_SAMPLED = 64
_MOST_RANGES = 1024


def _place(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _bounds(df: DataFrame, order: Sequence[str], ranges: int) -> list:
    """``ranges`` - 1 values at most that part the order evenly: those of the rows with the least digests, a number that the input does not change."""
    sample = df.select(*order).withColumn("_d", F.xxhash64(*order)).orderBy("_d", *order).limit(_SAMPLED * ranges)
    at = Window.orderBy(*order)
    every = sample.withColumns({"_k": F.row_number().over(at), "_n": F.count("*").over(Window.partitionBy())})  # the sample's rows
    cut = every.where(F.floor(F.col("_k") * ranges / F.col("_n")) > F.floor((F.col("_k") - 1) * ranges / F.col("_n"))).where("_k < _n")
    return [[r[c] for c in order] for r in cut.orderBy("_k").select(*order).collect()]


def range_of(df: DataFrame, order: str | Sequence[str], ranges: int | None = None) -> Column:
    """The number of each row's range, by a binary search among literals."""
    order = [order] if isinstance(order, str) else list(order)
    if ranges is None:
        ranges = min(_MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = dict(df.dtypes)
    bounds = [F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, row, strict=True)]) for row in _bounds(df, order, ranges)]
    place = _place(order)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(place < bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def summed_before(df: DataFrame, order: str | Sequence[str], value: str | Column, into: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value``, a whole number, over all rows of a lesser ``order``, which is unique; nulls come first."""
    order = [order] if isinstance(order, str) else list(order)
    value = F.col(value) if isinstance(value, str) else value
    ranged = df.withColumn("_range", range_of(df, order, ranges))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    mine = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(mine), F.lit(0))
    # a row for each range
    return ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn(into, (F.col("_inside") + F.col("_offset")).cast("long")).drop("_range", "_inside", "_offset")


def numbered(df: DataFrame, order: str | Sequence[str], into: str, ranges: int | None = None) -> DataFrame:
    """``df`` with its rows' numbers, from 0, in a unique order."""
    return summed_before(df, order, F.lit(1), into, ranges)


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str, ranges: int | None = None) -> DataFrame:
    """The same within each key, so that no key need fit a task; ``keys`` and ``order`` together are unique."""
    every = numbered(df, [*keys, *order], "_number", ranges)
    first = every.groupBy(*keys).agg(F.min("_number").alias("_first"))
    return every.join(first, list(keys)).withColumn(into, F.col("_number") - F.col("_first")).drop("_number", "_first")
