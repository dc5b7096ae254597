"""Regions: connected components of flagged pixels and what is measured of them.

An image is dealt in tiles of ``TILE`` pixels a side.  Within a tile pixels are
joined by arrays, for all tiles that a task has gathered at once; what touches over
a tile's border is joined by rounds of joins over those few pixels.  So an image of
any size is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graphs, ranks

#: Pixels a side of a tile.
TILE = 64
#: Pixels that a task works on at once; a tile is never split.
_GATHERED = 1 << 16
#: Half of a pixel's eight neighbours: each contact once.
_NEAR = ((0, 1), (1, -1), (1, 0), (1, 1))


def _tiles(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of about ``_GATHERED`` rows that end where one of the first columns changes; rows come sorted by those."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows and rows >= _GATHERED:
            last = [held[-1].column(k)[-1] for k in range(keys)]
            same = 0
            while same < batch.num_rows and all(batch.column(k)[same] == last[k] for k in range(keys)):
                same += 1
            held.append(batch.slice(0, same))
            batch = batch.slice(same)
            if batch.num_rows:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


class _Tiles:
    """Pixels of several tiles, sorted by tile, then ix and iy, with the pairs (a, b) of rows that touch within a tile."""

    def __init__(self, table: pa.Table, keys: int, tile: int):
        n = table.num_rows
        fresh = np.zeros(n, dtype=bool)
        for k in range(keys):
            column = table.column(k).combine_chunks()
            if pa.types.is_string(column.type):
                column = column.dictionary_encode().indices
            x = column.to_numpy(zero_copy_only=False)
            fresh[1:] |= x[1:] != x[:-1]
        self.ix, self.iy = (table.column(c).to_numpy() for c in ("ix", "iy"))
        self.tile, self.side = np.cumsum(fresh), tile + 2  # a rim, so that neighbours outside stay outside
        self.codes = (self.tile * self.side + self.ix % tile + 1) * self.side + self.iy % tile + 1

    def contacts(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        for dx, dy in _NEAR:
            at = np.searchsorted(self.codes, self.codes + dx * self.side + dy)
            at[at == len(self.codes)] = 0
            hit = np.flatnonzero(self.codes[at] == self.codes + dx * self.side + dy)
            a.append(hit)
            b.append(at[hit])
        return np.concatenate(a), np.concatenate(b)


def _least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each row's least row among those that pairs connect, by hooking and halving of paths."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]
    return root


def _tiled(pixels: DataFrame, tile: int) -> DataFrame:
    """Pixels with their tile (tx, ty), sorted by it, each tile in one task."""
    placed = pixels.withColumn("tx", F.floor(F.col("ix") / tile)).withColumn("ty", F.floor(F.col("iy") / tile))
    return placed.repartition("obsid", "tx", "ty").sortWithinPartitions("obsid", "tx", "ty", "ix", "iy")


def _over_borders(pixels: DataFrame, tile: int, columns: list[str]) -> DataFrame:
    """(obsid, a, b): the structs of ``columns`` of every two pixels of different tiles that touch."""
    rim = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    edge = pixels.where(rim("ix") | rim("iy")).select("obsid", "ix", "iy", F.floor(F.col("ix") / tile).alias("tx"), F.floor(F.col("iy") / tile).alias("ty"), F.struct(*columns).alias("a"))
    near = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _NEAR]))
    moved = edge.withColumn("d", near).select("obsid", (F.col("ix") + F.col("d.x")).alias("ix"), (F.col("iy") + F.col("d.y")).alias("iy"), F.col("tx").alias("ux"), F.col("ty").alias("uy"), F.col("a").alias("b"))
    return moved.join(edge, ["obsid", "ix", "iy"]).where("tx <> ux or ty <> uy").select("obsid", "a", "b")


def _in_order(labelled: DataFrame) -> DataFrame:
    """``root`` (struct of obsid, ix, iy) as numbers within each observation, in raster order."""
    roots = labelled.select("obsid", F.col("root.ix").alias("_x"), F.col("root.iy").alias("_y")).distinct()
    numbers = ranks.numbered_within(roots, ["obsid"], ["_x", "_y"], "label")
    flat = labelled.withColumns({"_x": F.col("root.ix"), "_y": F.col("root.iy")}).drop("root")
    return flat.join(numbers, ["obsid", "_x", "_y"]).drop("_x", "_y")


def components(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Flagged pixels (obsid, ix, iy, ...) with their component's label.

    Eight neighbours touch; an image's components are numbered from 0 by their first
    pixel in raster order.  Of repeated pixels one stays.
    """
    once = pixels.dropDuplicates(["obsid", "ix", "iy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tiles(batches, 3):
            tiles = _Tiles(table, 3, tile)
            root = _least_joined(table.num_rows, *tiles.contacts())
            columns = [table.column(c) for c in ("obsid", "ix", "iy")]
            out = pa.table([*columns, pa.array(tiles.ix[root]), pa.array(tiles.iy[root])], names=["obsid", "ix", "iy", "rx", "ry"])
            yield from out.to_batches()

    kind = dict(pixels.dtypes)["obsid"]
    keyed = _tiled(once.select("obsid", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")), tile).select("obsid", "tx", "ty", "ix", "iy")
    local = graphs._kept(keyed.mapInArrow(run, f"obsid {kind}, ix long, iy long, rx long, ry long"), "tiles")
    node = F.struct("obsid", F.col("rx").alias("ix"), F.col("ry").alias("iy"))
    tied = _over_borders(local.withColumn("node", node), tile, ["node"]).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    roots = graphs.components(tied).withColumnRenamed("root", "_root")
    joined = local.withColumn("node", node).join(roots, "node", "left").select("obsid", "ix", "iy", F.coalesce("_root", "node").alias("root"))
    return once.join(_in_order(joined), ["obsid", "ix", "iy"]).select(*pixels.columns, "label")


def region_counts(image: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    """(obsid, level, n_regions): the regions of pixels above each value that occurs, the greatest first to have none.

    Pixels come in falling order; each is a region of its own until the heaviest
    contact that it has not yet joins it to another.  So the regions above a level
    are the pixels above it less the contacts above it of a heaviest spanning
    forest, a contact weighing what the lesser of its pixels does.  The forest is
    found within tiles first, where a lighter contact of a circle can never count,
    and then over all contacts that are left.  All levels come of one forest.
    """
    once = image.where(F.col(value).isNotNull()).select("obsid", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col(value).cast("double").alias("v")).dropDuplicates(["obsid", "ix", "iy"])
    kind = dict(image.dtypes)["obsid"]

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tiles(batches, 3):
            tiles = _Tiles(table, 3, tile)
            v = table.column("v").to_numpy()
            a, b = _heaviest(table.num_rows, *tiles.contacts(), v)
            obsid = table.column("obsid").combine_chunks()
            out = pa.table([obsid.take(pa.array(a)), *[pa.array(x) for x in (tiles.ix[a], tiles.iy[a], tiles.ix[b], tiles.iy[b], np.minimum(v[a], v[b]))]], names=["obsid", "ax", "ay", "bx", "by", "w"])
            yield from out.to_batches()

    placed = _tiled(once, tile).select("obsid", "tx", "ty", "ix", "iy", "v")
    inside = placed.mapInArrow(forest, f"obsid {kind}, ax long, ay long, bx long, by long, w double")
    end = lambda x, y: F.struct("obsid", F.col(x).alias("ix"), F.col(y).alias("iy"))
    edges = inside.select(end("ax", "ay").alias("a"), end("bx", "by").alias("b"), "w")
    over = _over_borders(once, tile, ["ix", "iy", "v"])
    over = over.select(F.struct("obsid", "a.ix", "a.iy").alias("a"), F.struct("obsid", "b.ix", "b.iy").alias("b"), F.least("a.v", "b.v").alias("w"))
    if over.isEmpty():
        kept = edges  # no contact leaves a tile, so the tiles' forests are the whole
    else:
        kept = graphs.heaviest_forest(graphs._kept(edges.unionByName(over), "contacts"))
    changes = once.select("obsid", F.col("v").alias("level"), F.lit(1).alias("d")).unionByName(kept.select(F.col("a.obsid").alias("obsid"), F.col("w").alias("level"), F.lit(-1).alias("d")))
    steps = changes.groupBy("obsid", "level").agg(F.sum("d").alias("d"))
    # values below a level do not count towards it
    above = ranks.summed_before(steps.withColumn("_down", -F.col("level")), ["obsid", "_down"], "d", "_sum").drop("_down")
    first = above.groupBy("obsid").agg(F.max_by("_sum", "level").alias("_first"))
    return above.join(first, "obsid").select("obsid", "level", (F.col("_sum") - F.col("_first")).alias("n_regions"))


def _heaviest(n: int, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contacts of a heaviest spanning forest, taken in rounds: each tree takes its heaviest contact to another."""
    order = np.argsort(-np.minimum(v[a], v[b]), kind="stable")
    a, b = a[order], b[order]
    place, root, taken = np.arange(len(a)), np.arange(n), []
    while True:
        ra, rb = root[a[place]], root[b[place]]
        place = place[ra != rb]
        if not len(place):
            break
        ra, rb = root[a[place]], root[b[place]]
        first = np.full(n, len(a))
        np.minimum.at(first, ra, place)
        np.minimum.at(first, rb, place)
        best = np.unique(first[first < len(a)])
        taken.append(best)
        root = _least_joined(n, np.concatenate((np.arange(n), a[best])), np.concatenate((root, b[best])))
    at = np.concatenate(taken) if taken else np.zeros(0, dtype=np.int64)
    return a[at], b[at]


def optimised_sigma(image: DataFrame, value: str, target: int, bounds: tuple[float, float] = (0.1, 20.0), tile: int = TILE) -> DataFrame:
    """(obsid, sigma, level, n_regions): the least sigma within bounds whose threshold, mean + sigma deviations, leaves a number of regions nearest to ``target``.

    The number of regions only changes where the threshold passes a value, so the
    candidates are the least bound and the values within the bounds.
    """
    stats = image.groupBy("obsid").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    low, high = (F.col("m") + x * F.col("s") for x in bounds)
    counts = region_counts(image, value, tile).join(stats, "obsid")
    # at a threshold between two values, as many regions as above the lesser one
    at_low = counts.where(F.col("level") <= low).groupBy("obsid").agg(F.max_by("n_regions", "level").alias("n_regions"), F.max("m").alias("m"), F.max("s").alias("s")).withColumn("level", low)
    inside = counts.where((F.col("level") > low) & (F.col("level") <= high)).select("obsid", "n_regions", "m", "s", "level")
    # a value within the bounds needs a sigma of its own only where there is a spread
    every = at_low.select(*inside.columns).unionByName(inside)
    sigma = F.when(F.col("s") > 0, (F.col("level") - F.col("m")) / F.col("s")).otherwise(bounds[0])
    best = every.withColumn("sigma", sigma).groupBy("obsid").agg(F.min_by(F.struct("sigma", "level", "n_regions"), F.struct(F.abs(F.col("n_regions") - target), "level")).alias("x"))
    return best.select("obsid", "x.sigma", "x.level", "x.n_regions")


def properties(labelled: DataFrame, intensity: str = "total") -> DataFrame:
    """Box (half-open), centroids, mean intensity, equivalent diameter and box area of every region."""
    w = F.col(intensity)
    out = labelled.groupBy("obsid", "label").agg(
        F.min("ix").alias("bbox_0"), F.min("iy").alias("bbox_1"), (F.max("ix") + 1).alias("bbox_2"), (F.max("iy") + 1).alias("bbox_3"), F.avg("ix").alias("centroid_0"), F.avg("iy").alias("centroid_1"),
        (F.sum(F.col("ix") * w) / F.sum(w)).alias("weighted_0"), (F.sum(F.col("iy") * w) / F.sum(w)).alias("weighted_1"), F.avg(w).alias("intensity_mean"), F.count("*").alias("area"),
    )
    box = (F.col("bbox_2") - F.col("bbox_0")) * (F.col("bbox_3") - F.col("bbox_1"))
    return out.withColumn("equivalent_diameter", F.sqrt(4 * F.col("area") / np.pi)).withColumn("area_bbox", box)


def by_intensity(regions: DataFrame) -> DataFrame:
    """Labels anew, the brightest first, from 0."""
    order = Window.partitionBy("obsid").orderBy(F.desc("intensity_mean"), "label")
    return regions.withColumn("label", (F.row_number().over(order) - 1).cast("long"))
