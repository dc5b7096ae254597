"""Connected components and heaviest spanning forests as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: a round starts from files, whatever becomes of executors."""
    path = store.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the least node of its component.

    Larger neighbours are tied to the least one, then all to the least of those, in
    turn, until nothing moves: a number of rounds that grows with the logarithm of
    the component.  Nodes may be of any type that has an order.
    """
    stars = _kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    mark = _mark(stars)
    while mark[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = _kept(moved.unionByName(nearest.withColumnRenamed("m", "v")).distinct(), "stars")
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def heaviest_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of a spanning forest of greatest weight, ties by the ends: its weights are those of any.

    In every round each component takes its heaviest edge to another one; what is
    so joined becomes one component.  At least half of the components that have an
    edge left go in a round.
    """
    open_ = _kept(edges.where("a <> b").select(F.col("a").alias("ra"), F.col("b").alias("rb"), "a", "b", "w"), "open")
    taken = None
    while not open_.isEmpty():
        order = F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        ends = open_.select(F.explode(F.array("ra", "rb")).alias("r"), order.alias("o"), "ra", "rb", "a", "b", "w")
        best = ends.groupBy("r").agg(F.max_by(F.struct("ra", "rb", "a", "b", "w"), "o").alias("e")).select("e.*").dropDuplicates(["a", "b"])
        best = _kept(best, "best")
        taken = best.select("a", "b", "w") if taken is None else taken.unionByName(best.select("a", "b", "w"))
        roots = components(best.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        to = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_new"))
        moved = open_.join(to("ra"), "ra", "left").join(to("rb"), "rb", "left")
        moved = moved.select(F.coalesce("ra_new", "ra").alias("ra"), F.coalesce("rb_new", "rb").alias("rb"), "a", "b", "w").where("ra <> rb")
        # of parallel edges the heaviest
        pair = Window.partitionBy(F.least("ra", "rb"), F.greatest("ra", "rb")).orderBy(F.desc("w"), F.least("a", "b").desc(), F.greatest("a", "b").desc())
        open_ = _kept(moved.withColumn("_k", F.row_number().over(pair)).where("_k = 1").drop("_k"), "open")
    return edges.select("a", "b", "w").where("false") if taken is None else taken
