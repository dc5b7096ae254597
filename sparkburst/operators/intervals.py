"""Intervals in time: bad times of a rate, frames they touch, and groups of overlapping event lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cube import frames_of


def high_energy_curve(events: DataFrame, frame_us: int, lo: int = 10_000, hi: int = 12_000) -> DataFrame:
    """Rate per second of hard events (ends excluded) in every frame of the observation, empty ones included."""
    it = F.expr(f"t_us div {frame_us}")
    frames = frames_of(events.select("obsid", it.alias("it")))
    hard = events.where((F.col("pi") > lo) & (F.col("pi") < hi)).groupBy("obsid", it.alias("it")).agg(F.count("*").alias("n"))
    rate = F.coalesce("n", F.lit(0).cast("long"))
    return frames.join(hard, ["obsid", "it"], "left").select("obsid", "it", rate.alias("n"), (rate / (frame_us / 1e6)).alias("rate"))


def bad_times(curve: DataFrame, threshold: float, value: str = "rate") -> DataFrame:
    """(obsid, start, stop) frames of bad times.

    An interval starts with the frame before the rise, or with the first frame
    if that is bad, and stops with its last bad frame.
    """
    by_time = Window.partitionBy("obsid").orderBy("it")
    bad = curve.withColumn("bad", F.col(value) > threshold)
    edges = bad.withColumn("before", F.lag("bad").over(by_time)).withColumn("prev_it", F.lag("it").over(by_time)).withColumn("after", F.lead("bad").over(by_time))
    starts = edges.where(F.col("bad") & ~F.coalesce("before", F.lit(False))).withColumn("at", F.coalesce("prev_it", "it"))
    stops = edges.where(F.col("bad") & ~F.coalesce("after", F.lit(False)))
    nth = F.row_number().over(by_time)
    return starts.select("obsid", nth.alias("k"), F.col("at").alias("start")).join(stops.select("obsid", nth.alias("k"), F.col("it").alias("stop")), ["obsid", "k"]).drop("k")


def bad_bins(edges: DataFrame, intervals: DataFrame) -> DataFrame:
    """(obsid, k) of time bins in bad times: from the first edge not before the start up to the one before the first edge not before the stop.

    ``edges`` is (obsid, k, t), intervals (obsid, start, stop) in the same unit as t.
    """
    # edges before each end of an interval, by one running count over edges and ends together
    mark = lambda c: F.struct(F.lit(c).alias("end"), "start", "stop")
    none = F.lit(None).cast("struct<end:string,start:long,stop:long>")
    ends = intervals.select("obsid", F.explode(F.array(F.struct(F.col("start").alias("t"), mark("a").alias("m")), F.struct(F.col("stop").alias("t"), mark("b").alias("m")))).alias("x"))
    rows = edges.select("obsid", F.col("t").cast("long").alias("t"), none.alias("m")).unionByName(ends.select("obsid", F.col("x.t").cast("long").alias("t"), F.col("x.m").cast("struct<end:string,start:long,stop:long>").alias("m")))
    before = Window.partitionBy("obsid").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("c", F.count_if(F.col("m").isNull()).over(before)).where("m is not null")
    counted = seen.groupBy("obsid", "m.start", "m.stop").agg(F.max(F.when(F.col("m.end") == "a", F.col("c"))).alias("a"), (F.max(F.when(F.col("m.end") == "b", F.col("c"))) - 1).alias("b"))
    ranges = counted.where("b > a").select("obsid", F.explode(F.sequence("a", F.col("b") - 1)).alias("k"))
    return ranges.distinct()


def overlap_groups(lists: DataFrame) -> DataFrame:
    """Event lists with the number of the island of overlapping (inclusive) intervals that they belong to."""
    order = Window.partitionBy("obsid").orderBy("lo", "hi", "evt_file")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True))
    return lists.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def longest_per_instrument(grouped: DataFrame) -> DataFrame:
    """Of islands of more than three lists, the longest list of each instrument."""
    island = Window.partitionBy("obsid", "island")
    best = Window.partitionBy("obsid", "island", "instrument").orderBy(F.desc("exposure"), "evt_file")
    ranked = grouped.withColumn("_n", F.count("*").over(island)).withColumn("_r", F.row_number().over(best))
    return ranked.where("_n <= 3 or _r = 1").drop("_n", "_r")


def merged(grouped: DataFrame) -> DataFrame:
    """One row per island: instruments, and the intersection of the lists' times."""
    return grouped.groupBy("obsid", "island").agg(
        F.count("*").alias("n_lists"), F.max("lo").alias("time_min"), F.min("hi").alias("time_max"), F.array_join(F.array_sort(F.collect_list("instrument")), ",").alias("instruments")
    )


def clusters_in_time(points: DataFrame, key: str, t: str, eps: int, min_samples: int) -> DataFrame:
    """One-dimensional density clusters: points with ``min_samples`` within ``eps`` are cores, cores within ``eps`` are one cluster."""
    near = Window.partitionBy(key).orderBy(t).rangeBetween(-eps, eps)
    order = Window.partitionBy(key).orderBy(t)
    cores = points.withColumn("core", F.count("*").over(near) >= min_samples).where("core")
    new = F.coalesce(F.col(t) - F.lag(t).over(order) > eps, F.lit(True)).cast("int")
    return cores.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0))).groupBy(key, "cluster").agg(F.count("*").alias("n_core"), F.min(t).alias("t_lo"), F.max(t).alias("t_hi"))
