"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, written


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, whatever their order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that ``edges`` names; the root is the component's smallest node.

    The number of rounds grows with the logarithm of a component's size.  Every
    round starts from a written table, so a lost executor costs one round at most.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    stars = written(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(moved.unionByName(nearest.withColumnRenamed("m", "v")).distinct(), "edges")
        discard(stars)
        stars, before, mark = after, mark, _mark(after)
        if mark == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
