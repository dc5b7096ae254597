"""Expectation of a cube: source masks, background templates and the outer product of template and light curve."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gamma import log_pmf
from ..functions.geometry import sky_to_pixel
from . import regions


def expectation(cells: DataFrame) -> DataFrame:
    """mu = pixel's total * frame's total / total of the observation, for the occupied cells."""
    pixel = cells.groupBy("obsid", "ix", "iy").agg(F.sum("n").alias("n_pixel"))
    frame = cells.groupBy("obsid", "it").agg(F.sum("n").alias("n_frame"))
    total = cells.groupBy("obsid").agg(F.sum("n").alias("n_total"))
    mu = F.col("n_pixel") * F.col("n_frame") / F.col("n_total")
    return cells.join(pixel, ["obsid", "ix", "iy"]).join(frame, ["obsid", "it"]).join(total, "obsid").select("obsid", "ix", "iy", "it", "n", mu.alias("mu"))


def source_disks(pixels: DataFrame, sources: DataFrame) -> DataFrame:
    """Pixels within a source's radius: 4 cells for a rate over 1, 2 over 0.1, else 1 (80, 40 and 20 arcseconds).

    A source is exploded to the pixels of its square, so the join is on pixels.
    """
    return pixels.join(disk_pixels(sources), ["obsid", "ix", "iy"], "left_semi")


def disk_pixels(sources: DataFrame) -> DataFrame:
    """(obsid, ix, iy) of all pixels within a source's radius, on an image or not."""
    r = F.when(F.col("rate") > 1, 4).when(F.col("rate") > 0.1, 2).otherwise(1)
    near = sources.withColumn("r", r).withColumn("ix", F.explode(F.expr("sequence(sx - r, sx + r)"))).withColumn("iy", F.explode(F.expr("sequence(sy - r, sy + r)")))
    return near.where("(ix - sx) * (ix - sx) + (iy - sy) * (iy - sy) < r * r").select("obsid", "ix", "iy").distinct()


def known_sources(source_list: DataFrame, cell_arcsec: float = 20.0) -> DataFrame:
    """Sources to be masked, likely ones only, with kind and radius in arcseconds: by rate for point sources, their extent for others."""
    rate = F.col("total_rate")
    of_point = F.when(rate > 1, 80.0).when(rate > 0.1, 40.0).otherwise(cell_arcsec)
    likely = source_list.where((F.col("det_ml") > 8) & (F.col("extent") >= 0))
    point = F.col("extent") == 0
    return likely.withColumn("kind", F.when(point, "point").otherwise("extended")).withColumn("radius", F.when(point, of_point).otherwise(F.col("extent")))


def on_cube(sources: DataFrame, wcs: DataFrame, x_edges: tuple[float, float, int], y_edges: tuple[float, float, int]) -> DataFrame:
    """Sources with their place in the cube: pixel of the image, 80 sky units each, then interpolated between the cube's edges.

    ``wcs`` has one row of constants an observation; the edges are (low, high, number
    of edges).  Sources outside the edges are left out.
    """
    px, py = sky_to_pixel(F.col("ra_deg"), F.col("dec_deg"), (F.col("crpix_x"), F.col("crpix_y")), (F.col("cdelt_x"), F.col("cdelt_y")), (F.col("crval_x"), F.col("crval_y")))
    placed = sources.join(wcs, "obsid").withColumn("x_sky", px * 80).withColumn("y_sky", py * 80)
    inside = (F.col("x_sky") > x_edges[0]) & (F.col("x_sky") < x_edges[1]) & (F.col("y_sky") > y_edges[0]) & (F.col("y_sky") < y_edges[1])
    at = lambda c, e: (F.col(c) - e[0]) / (e[1] - e[0]) * (e[2] - 1)
    return placed.where(inside).withColumn("x_cube", at("x_sky", x_edges)).withColumn("y_cube", at("y_sky", y_edges)).select(*sources.columns, "x_sky", "y_sky", "x_cube", "y_cube")


def above_percentile(image: DataFrame, share: float, column: str = "total", factor: float = 1.0) -> DataFrame:
    """Pixels above ``factor`` times the image's exact percentile (linear interpolation)."""
    level = image.groupBy("obsid").agg(F.percentile(column, F.lit(share)).alias("level"))
    return image.join(level, "obsid").where(F.col(column) > factor * F.col("level"))


def source_mask(image: DataFrame, sources: DataFrame) -> DataFrame:
    """Pixels on a listed source, or over three times the upper quartile of the others."""
    listed = source_disks(image, sources).select("obsid", "ix", "iy")
    rest = image.join(listed, ["obsid", "ix", "iy"], "left_anti")
    return listed.unionByName(above_percentile(rest, 0.75, factor=3.0).select("obsid", "ix", "iy"))


def clipped_statistics(image: DataFrame, sigma: float = 3.0, rounds: int = 5, column: str = "total") -> DataFrame:
    """Mean, median and deviation after ``rounds`` of dropping what is further than ``sigma`` deviations from the median."""
    kept = image
    for _ in range(rounds):
        level = kept.groupBy("obsid").agg(F.median(column).alias("m"), F.stddev_pop(column).alias("s"))
        kept = kept.join(level, "obsid").where(F.abs(F.col(column) - F.col("m")) <= sigma * F.col("s")).drop("m", "s")
    return kept.groupBy("obsid").agg(F.count("*").alias("n_kept"), F.avg(column).alias("mean_c"), F.median(column).alias("median_c"), F.stddev_pop(column).alias("std_c"))


def box_of(image: DataFrame) -> DataFrame:
    """Each image's bounding box (x0, x1, y0, y1), ends included: a row an image."""
    return image.groupBy("obsid").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"))


def _solved(hole: np.ndarray, count: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """The values that each equal the mean of their neighbours: count v = known + sum over contacts (a, b); conjugate gradients.

    ``hole`` numbers each pixel's hole, from 0 and in order.  A hole takes its own
    steps until it has settled; all holes take them at once.  Without a known
    neighbour there is nothing to go by: zeros.
    """
    out = np.zeros(len(hole))
    at = np.arange(len(hole))  # the pixels that have not settled
    size = np.bincount(hole)
    summed = lambda x: np.bincount(hole, weights=x, minlength=len(size))
    apply = lambda x: count * x - np.bincount(a, weights=x[b], minlength=len(x))
    v = (summed(known) / np.maximum(1.0, summed(count)))[hole]
    v[(summed(np.abs(known)) == 0)[hole]] = 0.0
    r = known - apply(v)
    p, rr = r.copy(), summed(r * r)
    bound = tolerance**2 * np.maximum(summed(known * known), 1e-300)
    last = np.where(summed(np.abs(known)) == 0, 0, 20 * size + 100)
    steps = 0
    while True:
        open_ = (rr > bound) & (steps < last)
        if 2 * np.count_nonzero(open_) <= len(open_):  # holes that have settled leave
            stay = open_[hole]
            out[at[~stay]] = v[~stay]
            if not stay.any():
                return out
            number, place = np.cumsum(open_) - 1, np.cumsum(stay) - 1
            kept = stay[a]
            a, b = place[a[kept]], place[b[kept]]
            at, hole, count, v, r, p = at[stay], number[hole[stay]], count[stay], v[stay], r[stay], p[stay]
            size, rr, bound, last, open_ = size[open_], rr[open_], bound[open_], last[open_], open_[open_]
        q = apply(p)
        step = np.where(open_, rr / np.where(open_, summed(p * q), 1.0), 0.0)[hole]
        v += step * p
        r -= step * q
        before, rr = rr, np.where(open_, summed(r * r), rr)
        p = np.where(open_[hole], r + (rr / np.where(open_, before, 1.0))[hole] * p, p)
        steps += 1


def _touching(hole: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b), both ways round, of pixels of one hole that touch; pixels come sorted by hole, ix and iy."""
    first = np.flatnonzero(np.diff(hole, prepend=-1))
    x, y = ix - np.minimum.reduceat(ix, first)[hole] + 1, iy - np.minimum.reduceat(iy, first)[hole] + 1
    codes = (hole * (x.max() + 2) + x) * (y.max() + 2) + y
    a, b = [], []
    for move in (dx * (y.max() + 2) + dy for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy):
        near = np.minimum(np.searchsorted(codes, codes + move), len(codes) - 1)
        hit = np.flatnonzero(codes[near] == codes + move)
        a.append(hit)
        b.append(near[hit])
    return np.concatenate(a), np.concatenate(b)


def fill_holes(image: DataFrame, holes: DataFrame, value: str, box: DataFrame | None = None) -> DataFrame:
    """(obsid, ix, iy, value) of ``holes`` such that each is the mean of its eight neighbours, as far as they are within the image's box.

    Pixels of the box that have no row are zero.  A hole is a group of touching
    pixels; it is solved by itself, to convergence, with what its rim is.  A task
    solves the holes that it has gathered at once.
    """
    box = box_of(image) if box is None else box
    inside = holes.select("obsid", "ix", "iy").distinct().join(box, "obsid").where("ix between x0 and x1 and iy between y0 and y1")
    labelled = regions.components(inside.select("obsid", "ix", "iy"))
    near = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]))
    reach = labelled.join(box, "obsid").withColumn("d", near).withColumns({"nx": F.col("ix") + F.col("d.x"), "ny": F.col("iy") + F.col("d.y")}).where("nx between x0 and x1 and ny between y0 and y1")
    known = image.select("obsid", F.col("ix").alias("nx"), F.col("iy").alias("ny"), F.col(value).cast("double").alias("v"))
    is_hole = labelled.select("obsid", F.col("ix").alias("nx"), F.col("iy").alias("ny"), F.lit(True).alias("open"))
    met = reach.join(is_hole, ["obsid", "nx", "ny"], "left").join(known, ["obsid", "nx", "ny"], "left")
    rim = F.sum(F.when(F.col("open").isNull(), F.coalesce("v", F.lit(0.0))).otherwise(0.0))
    rows = met.groupBy("obsid", "label", "ix", "iy").agg(F.count("*").cast("double").alias("count"), rim.alias("known"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regions._tiles(batches, 2):
            obsid, label, ix, iy, count, known = (table.column(c).combine_chunks() for c in ("obsid", "label", "ix", "iy", "count", "known"))
            image_of = obsid.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            label, x, y = label.to_numpy(), ix.to_numpy(), iy.to_numpy()
            fresh = np.zeros(len(label), dtype=np.int64)
            fresh[1:] = (label[1:] != label[:-1]) | (image_of[1:] != image_of[:-1])
            hole = np.cumsum(fresh)
            v = _solved(hole, count.to_numpy(), known.to_numpy(), *_touching(hole, x, y))
            yield from pa.table([obsid, ix, iy, pa.array(v)], names=["obsid", "ix", "iy", "v"]).to_batches()

    kind = dict(image.dtypes)["obsid"]
    dealt = rows.repartition("obsid", "label").sortWithinPartitions("obsid", "label", "ix", "iy")
    solved = dealt.mapInArrow(solve, f"obsid {kind}, ix long, iy long, v double")
    return solved.withColumnRenamed("v", value)


def blurred(image: DataFrame, value: str, sigma: float, box: DataFrame | None = None) -> DataFrame:
    """(obsid, ix, iy, value): a Gaussian blur of sparse pixels within their box, mirrored at its edges (half-sample symmetric).

    The stencil is separable: one pass along each axis deals every pixel to what it
    reaches, its mirror images included, and sums.  No task holds an image.
    """
    r = max(1, int(4 * sigma + 0.5))
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    taps = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / sum(weights)).alias("w")) for d, w in zip(range(-r, r + 1), weights, strict=True)]))
    box = box_of(image) if box is None else box
    out = image.select("obsid", "ix", "iy", F.col(value).cast("double").alias("v"))
    for axis, lo, hi in (("ix", "x0", "x1"), ("iy", "y0", "y1")):
        other = "iy" if axis == "ix" else "ix"
        mirrors = F.explode(F.array(F.col(axis), 2 * F.col(lo) - 1 - F.col(axis), 2 * F.col(hi) + 1 - F.col(axis)))
        # only what stands within a stencil's reach of an edge has an image that matters
        seen = out.join(box.select("obsid", lo, hi), "obsid").withColumn("at", mirrors).where(F.col("at").between(F.col(lo) - r, F.col(hi) + r))
        dealt = seen.withColumn("t", taps).withColumn(axis, F.col("at") - F.col("t.d")).where(F.col(axis).between(F.col(lo), F.col(hi)))
        out = dealt.groupBy("obsid", axis, other).agg(F.sum(F.col("t.w") * F.col("v")).alias("v"))
    return out.select("obsid", "ix", "iy", F.col("v").alias(value))


def background_template(image: DataFrame, mask: DataFrame, sigma: float = 0.5, box: DataFrame | None = None) -> DataFrame:
    """Background per count outside sources: masked pixels filled from their rims, then a Gaussian blur; for the image's pixels.

    Pixels of the box (obsid, x0, x1, y0, y1: the image's own unless given) that have no row are without counts.
    """
    flat = image.select("obsid", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("total").cast("double").alias("total"))
    hidden = mask.select("obsid", "ix", "iy").distinct()
    outside = flat.join(hidden, ["obsid", "ix", "iy"], "left_anti")
    box = box_of(flat) if box is None else box
    whole = outside.unionByName(fill_holes(flat, hidden, "total", box))
    counts = outside.groupBy("obsid").agg(F.sum("total").alias("outside"))
    smooth = blurred(whole, "total", sigma, box).withColumnRenamed("total", "smooth")
    joined = flat.join(smooth, ["obsid", "ix", "iy"]).join(counts, "obsid", "left")
    return joined.select("obsid", "ix", "iy", (F.col("smooth") / F.greatest(F.coalesce("outside", F.lit(0.0)), F.lit(1.0))).alias("template"))


def likelihood_map(image: DataFrame, mask: DataFrame, template: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(obsid, ix, iy, surprise): minus the log of the Poisson probability of each pixel's counts as background alone, blurred."""
    outside = image.join(mask.select("obsid", "ix", "iy").distinct(), ["obsid", "ix", "iy"], "left_anti").groupBy("obsid").agg(F.sum("total").alias("outside"))
    expected = template.join(outside, "obsid").select("obsid", "ix", "iy", (F.col("template") * F.col("outside")).alias("mu"))
    held = image.join(expected, ["obsid", "ix", "iy"]).select("obsid", "ix", "iy", (-log_pmf(F.col("total"), F.col("mu"))).alias("surprise"))
    return blurred(held, "surprise", sigma, box_of(image))


def source_template(image: DataFrame, mask: DataFrame, template: DataFrame, frames: DataFrame) -> DataFrame:
    """Counts per exposed frame above the background, within the mask."""
    on = image.join(mask.select("obsid", "ix", "iy").distinct(), ["obsid", "ix", "iy"], "left_semi")
    outside = image.join(mask, ["obsid", "ix", "iy"], "left_anti").groupBy("obsid").agg(F.sum("total").alias("outside"))
    exposed = frames.groupBy("obsid").agg(F.count("*").alias("n_frames"))
    rate = F.greatest(F.lit(0.0), F.col("total") - F.col("template") * F.col("outside")) / F.col("n_frames")
    return on.join(template, ["obsid", "ix", "iy"]).join(outside, "obsid").join(exposed, "obsid").select("obsid", "ix", "iy", rate.alias("source_rate"))


def expectation_with_sources(cells: DataFrame, mask: DataFrame, template: DataFrame, sources: DataFrame) -> DataFrame:
    """mu = template * counts of the frame outside sources + the source's rate, for the given cells."""
    outside = cells.join(mask, ["obsid", "ix", "iy"], "left_anti").groupBy("obsid", "it").agg(F.sum("n").alias("n_out"))
    mu = F.col("template") * F.coalesce("n_out", F.lit(0)) + F.coalesce("source_rate", F.lit(0.0))
    joined = cells.join(template, ["obsid", "ix", "iy"]).join(outside, ["obsid", "it"], "left").join(sources, ["obsid", "ix", "iy"], "left")
    return joined.select("obsid", "ix", "iy", "it", "n", mu.alias("mu"))


def masked_sources(image: DataFrame, listed: DataFrame, factor: float = 3.0, share: float = 0.75, box: DataFrame | None = None) -> DataFrame:
    """Pixels of a list, or over ``factor`` times a quantile of the image's other pixels, those of its box without counts included."""
    keys = ["obsid", "ix", "iy"]
    listed = listed.select(*keys).distinct()
    box = box_of(image) if box is None else box
    held = image.join(listed, keys, "left_anti")
    inside = listed.join(box, "obsid").where("ix between x0 and x1 and iy between y0 and y1")
    empty = inside.groupBy("obsid").agg(F.count("*").alias("on_list")).join(box, "obsid", "right").join(held.groupBy("obsid").agg(F.count("*").alias("rows")), "obsid", "left")
    zeros = empty.select("obsid", F.lit(0).cast("long").alias("total"), ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) - F.coalesce("on_list", F.lit(0)) - F.coalesce("rows", F.lit(0))).alias("times"))
    # pixels without counts are one row, counted as often as there are of them
    every = held.select("obsid", F.col("total").cast("long").alias("total"), F.lit(1).cast("long").alias("times")).unionByName(zeros.where("times > 0"))
    counts = every.groupBy("obsid", "total").agg(F.sum("times").alias("times"))
    level = counts.groupBy("obsid").agg(F.percentile("total", F.lit(share), F.col("times")).alias("level"))
    bright = held.join(level, "obsid").where(F.col("total") > factor * F.col("level")).select(*keys)
    return inside.select(*keys).unionByName(bright)


def two_template_expectation(cells: DataFrame, bad_frames: DataFrame) -> DataFrame:
    """mu from a template of good and one of bad times, each its own pixels' shares times the frame's counts."""
    kinds = cells.join(bad_frames.select("obsid", "it").distinct().withColumn("_b", F.lit(True)), ["obsid", "it"], "left").withColumn("is_bti", F.coalesce("_b", F.lit(False))).drop("_b")
    pixel = kinds.groupBy("obsid", "is_bti", "ix", "iy").agg(F.sum("n").alias("n_pixel"))
    total = kinds.groupBy("obsid", "is_bti").agg(F.sum("n").alias("n_total"))
    frame = kinds.groupBy("obsid", "it").agg(F.sum("n").alias("n_frame"))
    mu = F.col("n_pixel") * F.col("n_frame") / F.col("n_total")
    return kinds.join(pixel, ["obsid", "is_bti", "ix", "iy"]).join(total, ["obsid", "is_bti"]).join(frame, ["obsid", "it"]).select("obsid", "ix", "iy", "it", "is_bti", "n", mu.alias("mu"))


def good_to_bad_ratio(cells: DataFrame, bad_frames: DataFrame) -> DataFrame:
    """Per pixel its share of the good counts over its share of the bad ones; null without bad counts."""
    kinds = cells.join(bad_frames.select("obsid", "it").distinct().withColumn("_b", F.lit(1)), ["obsid", "it"], "left").withColumn("_b", F.coalesce("_b", F.lit(0)))
    good, bad = F.sum(F.col("n") * (1 - F.col("_b"))), F.sum(F.col("n") * F.col("_b"))
    pixel = kinds.groupBy("obsid", "ix", "iy").agg(good.alias("g"), bad.alias("b"))
    total = kinds.groupBy("obsid").agg(good.alias("tg"), bad.alias("tb"))
    ratio = (F.col("g") / F.nullif("tg", F.lit(0))) / F.nullif(F.col("b") / F.nullif("tb", F.lit(0)), F.lit(0.0))
    return pixel.join(total, "obsid").select("obsid", "ix", "iy", ratio.alias("ratio"))
