"""Sparse histograms of events in pixels and time frames, and sums over them.

Only occupied cells are rows.  Where empty ones matter, ``dense`` restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frame of six hours, in microseconds.
FRAME_US = 21_600_000_000


def binned(events: DataFrame, frame_us: int = FRAME_US, frames: int | None = None) -> DataFrame:
    """n of every occupied (obsid, ix, iy, it); with ``frames``, only whole frames from the start count."""
    it = F.expr(f"t_us div {frame_us}")
    out = events.select("obsid", "ix", "iy", it.alias("it")).where("it >= 0")
    if frames is not None:
        out = out.where(F.col("it") < frames)
    return out.groupBy("obsid", "ix", "iy", "it").agg(F.count("*").alias("n"))


def binned_xyt(events: DataFrame, x_edges: tuple[float, float, int], y_edges: tuple[float, float, int], t_edges: tuple[int, int, int]) -> DataFrame:
    """Three-dimensional histogram on (low, high, bins) edges: left-closed bins, the last edge included, the rest dropped."""

    def index(c: str, lo: float, hi: float, n: int):
        k = F.floor((F.col(c) - lo) / ((hi - lo) / n)).cast("long")
        return F.when((F.col(c) < lo) | (F.col(c) > hi), None).otherwise(F.least(k, F.lit(n - 1).cast("long")))

    out = events.select("obsid", index("x", *x_edges).alias("ix"), index("y", *y_edges).alias("iy"), index("t_us", *t_edges).alias("it"))
    return out.where("ix is not null and iy is not null and it is not null").groupBy("obsid", "ix", "iy", "it").agg(F.count("*").alias("n"))


def frames_of(cells: DataFrame) -> DataFrame:
    """Every frame from the first to the last occupied one of an observation."""
    ends = cells.groupBy("obsid").agg(F.min("it").alias("lo"), F.max("it").alias("hi"))
    return ends.select("obsid", F.explode(F.sequence("lo", "hi")).alias("it"))


#: Pixels a side of the tiles in which pixels meet what is known of their observation.
_TILE = 64


def _pixel_rows(cells: DataFrame, known: DataFrame) -> DataFrame:
    """A row a pixel: its occupied cells (``_hits``), their sum (``_p``) and the columns of ``known``, a row an observation.

    Observations may be few and large, so pixels are dealt by tiles.
    """
    tile = {f"_t{c}": F.coalesce(F.floor(F.col(f"i{c}") / _TILE), F.lit(0)) for c in "xy"}
    placed = F.col("it").isNotNull() & F.col("ix").isNotNull() & F.col("iy").isNotNull()
    hits = F.collect_list(F.when(placed, F.struct("it", F.coalesce("n", F.lit(0).cast("long")).alias("n"))))
    pixels = cells.groupBy("obsid", "ix", "iy").agg(hits.alias("_hits"), F.sum("n").alias("_p")).withColumns(tile)
    tiles = cells.withColumns(tile).select("obsid", *tile).distinct().join(known, "obsid")
    return pixels.hint("merge").join(tiles, ["obsid", *tile]).drop(*tile)


def _filled(lo: Column, hi: Column) -> Column:
    """``_hits`` with a zero for every other frame."""
    others = F.array_except(F.sequence(lo, hi), F.transform("_hits", lambda h: h["it"]))
    return F.concat("_hits", F.transform(others, lambda k: F.struct(k.alias("it"), F.lit(0).cast("long").alias("n"))))


def dense(cells: DataFrame) -> DataFrame:
    """Cells with zeros: every pixel that was ever hit, in every frame."""
    ends = cells.groupBy("obsid").agg(F.min("it").alias("_lo"), F.max("it").alias("_hi"))
    rows = _pixel_rows(cells, ends)
    return rows.select("obsid", "ix", "iy", F.inline(_filled(F.col("_lo"), F.col("_hi"))))


def dense_expected(cells: DataFrame) -> DataFrame:
    """The same with ``mu``: a pixel's sum times its frame's over the observation's.

    No window holds an observation: sums are made before empty cells are, and the
    frames' sums go with the observation as an array.
    """
    held = cells.groupBy("obsid", "it").agg(F.sum("n").alias("_f"))
    frames = frames_of(cells).join(held, ["obsid", "it"], "left").select("obsid", "it", F.coalesce("_f", F.lit(0).cast("long")).alias("_f"))
    known = frames.groupBy("obsid").agg(F.min("it").alias("_lo"), F.max("it").alias("_hi"), F.sort_array(F.collect_list(F.struct("it", "_f"))).alias("_frames"), F.sum("_f").alias("_t"))
    mu = lambda c: F.col("_p") * F.get("_frames", (c["it"] - F.col("_lo")).cast("int"))["_f"] / F.col("_t")
    rows = _pixel_rows(cells, known).withColumn("_cells", F.transform(_filled(F.col("_lo"), F.col("_hi")), lambda c: F.struct(c["it"].alias("it"), c["n"].alias("n"), mu(c).alias("mu"))))
    return rows.select("obsid", "ix", "iy", F.inline("_cells"))


def images(cells: DataFrame) -> DataFrame:
    """Per pixel: sum, max, min, mean, median and population deviation over all frames, empty ones included."""
    spans = cells.groupBy("obsid").agg((F.max("it") - F.min("it") + 1).alias("frames"))
    # empty cells are one row a pixel, counted as often as there are of them
    held = cells.groupBy("obsid", "ix", "iy").agg(F.count("*").alias("hit")).join(spans, "obsid").where("frames > hit")
    empty = held.select("obsid", "ix", "iy", F.lit(0).cast("long").alias("n"), (F.col("frames") - F.col("hit")).alias("times"))
    rows = cells.select("obsid", "ix", "iy", "n", F.lit(1).cast("long").alias("times")).unionByName(empty)
    n, times = F.col("n"), F.col("times")
    sums = rows.groupBy("obsid", "ix", "iy").agg(
        F.sum("n").alias("total"), F.max("n").alias("max_n"), F.min("n").alias("min_n"), (F.sum(n * times) / F.sum(times)).alias("mean_n"), F.percentile("n", F.lit(0.5), F.col("times")).alias("median_n"), F.sum(n * n * times).alias("_squares"), F.sum(times).alias("_m")
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") / F.col("_m") - F.col("mean_n") * F.col("mean_n")))
    return sums.select("obsid", "ix", "iy", "total", "max_n", "min_n", "mean_n", "median_n", spread.alias("std_n"))


def variability(image: DataFrame) -> DataFrame:
    """Score (max - mean) * deviation of each pixel."""
    return image.withColumn("v_score", (F.col("max_n") - F.col("mean_n")) * F.col("std_n"))


def above_sigma(scored: DataFrame, sigma: float) -> DataFrame:
    """Pixels whose score exceeds the image's mean by ``sigma`` deviations."""
    level = scored.groupBy("obsid").agg((F.avg("v_score") + sigma * F.stddev_pop("v_score")).alias("level"))
    return scored.join(level, "obsid").where("v_score > level").drop("level")


def smoothed(image: DataFrame, column: str = "total") -> DataFrame:
    """Box mean over a pixel and its eight neighbours, those outside the image counted as zero."""
    near = F.explode(F.expr("flatten(transform(array(-1,0,1), a -> transform(array(-1,0,1), b -> struct(a as dx, b as dy))))"))
    moved = image.select("obsid", "ix", "iy", F.col(column).alias("v"), near.alias("d")).select("obsid", (F.col("ix") + F.col("d.dx")).alias("ix"), (F.col("iy") + F.col("d.dy")).alias("iy"), "v")
    sums = moved.groupBy("obsid", "ix", "iy").agg((F.sum("v") / 9).alias("smooth"))
    return image.select("obsid", "ix", "iy").join(sums, ["obsid", "ix", "iy"])


def bounding_box(cells: DataFrame) -> DataFrame:
    return cells.where("n > 0").groupBy("obsid").agg(F.min("ix").alias("ix_lo"), F.max("ix").alias("ix_hi"), F.min("iy").alias("iy_lo"), F.max("iy").alias("iy_hi"))


def cropped(cells: DataFrame) -> DataFrame:
    box = bounding_box(cells)
    return cells.join(box, "obsid").select("obsid", (F.col("ix") - F.col("ix_lo")).alias("ix"), (F.col("iy") - F.col("iy_lo")).alias("iy"), "it", "n")


def rebinned(cells: DataFrame, factor: int) -> DataFrame:
    """Frames summed in groups; the last group may be short."""
    return cells.groupBy("obsid", "ix", "iy", F.expr(f"it div {factor}").alias("it")).agg(F.sum("n").alias("n"))


def frame_exposures(cells: DataFrame, factor: int) -> DataFrame:
    return frames_of(cells).groupBy("obsid", F.expr(f"it div {factor}").alias("it")).agg(F.count("*").alias("exposure"))


def bad_ccd_frames(events: DataFrame, frame_us: int = FRAME_US) -> DataFrame:
    """(obsid, it, quad_max, quad_min, active, is_bad) of every frame, by the quadrants of three CCDs.

    A frame is bad if a quadrant's median count is zero while another's is not,
    and so is the frame that follows it; the frame after the last is the first.
    """
    return bad_ccd_frames_of(events.select("obsid", F.expr(f"t_us div {frame_us}").alias("it"), "ccdnr").groupBy("obsid", "it", "ccdnr").agg(F.count("*").alias("n")))


def bad_ccd_frames_of(hits: DataFrame) -> DataFrame:
    """The same from counts n of (obsid, it, ccdnr)."""
    grid = frames_of(hits).withColumn("ccdnr", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))))
    full = grid.join(hits, ["obsid", "it", "ccdnr"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    quadrants = full.groupBy("obsid", "it", F.expr("(ccdnr - 1) div 3").alias("quadrant")).agg(F.sum("n").alias("total"), F.median("n").alias("mid"))
    stats = quadrants.groupBy("obsid", "it").agg(F.max("mid").alias("quad_max"), F.min("mid").alias("quad_min"), F.count_if(F.col("total") > 0).alias("active"))
    flagged = stats.withColumn("dead", (F.col("quad_min") == 0) & (F.col("quad_max") > 0))
    by_time = Window.partitionBy("obsid").orderBy("it")
    whole = Window.partitionBy("obsid")
    last = F.max_by("dead", "it").over(whole)
    return flagged.withColumn("is_bad", F.col("dead") | F.coalesce(F.lag("dead").over(by_time), last)).drop("dead")


def light_curves(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """n per (obsid, label, it) over each region's half-open box; boxes are few and exploded to pixels."""
    return cells.join(box_pixels(boxes), ["obsid", "ix", "iy"]).groupBy("obsid", "label", "it").agg(F.sum("n").alias("n"))


def box_pixels(boxes: DataFrame) -> DataFrame:
    """(obsid, label, ix, iy) of every pixel of half-open boxes."""
    pixels = boxes.withColumn("ix", F.explode(F.sequence("bbox_0", F.col("bbox_2") - 1))).withColumn("iy", F.explode(F.sequence("bbox_1", F.col("bbox_3") - 1)))
    return pixels.select("obsid", "label", "ix", "iy")


def masked(cells: DataFrame, bad_frames: DataFrame) -> DataFrame:
    """Counts of bad frames become null and their exposure zero; the rows stay."""
    flagged = bad_frames.select("obsid", "it").distinct().withColumn("_bad", F.lit(True))
    joined = cells.join(flagged, ["obsid", "it"], "left")
    return joined.withColumn("n", F.when(F.col("_bad").isNull(), F.col("n"))).withColumn("exposure", F.when(F.col("_bad").isNull(), 1.0).otherwise(0.0)).drop("_bad")


def without_frames(cells: DataFrame, bad_frames: DataFrame) -> DataFrame:
    return cells.join(bad_frames.select("obsid", "it").distinct(), ["obsid", "it"], "left_anti")


def above_neighbours(image: DataFrame, offset: float = 0.0, column: str = "total") -> DataFrame:
    """Adaptive threshold: pixels above the mean of their 3 x 3 block less an offset."""
    return image.join(smoothed(image, column), ["obsid", "ix", "iy"]).where(F.col(column) > F.col("smooth") - offset).select("obsid", "ix", "iy", column)
