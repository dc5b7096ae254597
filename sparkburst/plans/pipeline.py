"""The detection run over a grid of parameters: one scan of the events for all runs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.bayes import significant, threshold
from ..operators import background, catalogues, crossmatch, cube, features, filters, intervals, ranks, regions
from ..sources import store

TIME_BINS = (300, 600, 1000)
BANDS = ((0.2, 2.0), (2.0, 12.0), (0.2, 12.0))


def parameter_grid(observations: DataFrame, time_bins: Sequence[int] = TIME_BINS, bands: Sequence[tuple[float, float]] = BANDS) -> DataFrame:
    """Every observation with every time bin and band: a handful of literals, exploded."""
    t = F.explode(F.array(*map(F.lit, time_bins))).alias("t_bin")
    e = F.explode(F.array(*[F.struct(F.lit(lo).alias("e_lo"), F.lit(hi).alias("e_hi")) for lo, hi in bands])).alias("band")
    return observations.select("obsid", t).select("obsid", "t_bin", e).select("obsid", "t_bin", "band.e_lo", "band.e_hi")


def runs(events: DataFrame, frame_scale_us: int = 1_000_000, time_bins: Sequence[int] = TIME_BINS, bands: Sequence[tuple[float, float]] = BANDS) -> DataFrame:
    """Occupied cells of every run, keyed by runid; each event is read once and dealt to its runs."""
    return _dealt(events, frame_scale_us, time_bins, bands).groupBy("obsid", "t_bin", "e_lo", "e_hi", "ix", "iy", "it").agg(F.count("*").alias("n"))


def _dealt(events: DataFrame, frame_scale_us: int, time_bins: Sequence[int], bands: Sequence[tuple[float, float]]) -> DataFrame:
    """Each event with every run that takes it: the columns of the run, and ``it``, its frame there."""
    band = F.filter(F.array(*[F.struct(F.lit(lo).alias("e_lo"), F.lit(hi).alias("e_hi")) for lo, hi in bands]), lambda b: (F.col("pi") > b["e_lo"] * 1000) & (F.col("pi") < b["e_hi"] * 1000))
    each = events.withColumn("_b", F.explode(band)).withColumn("t_bin", F.explode(F.array(*map(F.lit, time_bins))))
    return each.withColumns({"e_lo": F.col("_b.e_lo"), "e_hi": F.col("_b.e_hi"), "it": F.expr(f"t_us div (t_bin * {frame_scale_us}L)")}).drop("_b")


def run_summaries(events: DataFrame, frame_scale_us: int = 1_000_000) -> DataFrame:
    cells = runs(events, frame_scale_us)
    return cells.groupBy("obsid", "t_bin", "e_lo", "e_hi").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_events"), F.max("n").alias("max_n"))


def _run() -> Column:
    """The run of a cell: observation, subset, frame length and band."""
    return F.concat_ws("_", "obsid", F.lit("0"), F.col("t_bin").cast("string"), F.col("e_lo").cast("string"), F.col("e_hi").cast("string"))


def _timed() -> Column:
    """The observation with a frame length."""
    return F.concat_ws("_", "obsid", F.col("t_bin").cast("string"))


class TransientPipeline:
    """Detection over all runs of some events, each step a table keyed by run and made once.

    Frames in bad times of the hard light curve and with dead quadrants are left
    out as asked for.  What a run expects is a background template for good and one
    for bad times, scaled by the counts outside sources in each frame, and the mean
    rate of the sources.  Cells are held against that by the limit table, those
    without counts included where so much is expected that none is a dip.

    ``sources`` are known ones (obsid, sx, sy, rate) in pixels, ``wcs`` the constants
    of each observation's pixel plane (obsid, crpix_x, .. crval_y); either may be absent.
    Steps are written to the shared folder, so a later one never repeats an earlier one.
    """

    def __init__(
        self, events: DataFrame, limits: DataFrame, frame_scale_us: int = 1_000_000, time_bins: Sequence[int] = TIME_BINS, bands: Sequence[tuple[float, float]] = BANDS,
        sigma: float = 3, hard_rate: float = 0.5, good_times_only: bool = True, whole_frames_only: bool = True, sources: DataFrame | None = None, wcs: DataFrame | None = None, hard_bin: int = 100,
    ):
        self.events, self.limits, self.time_bins, self.bands, self.scale = events, limits, time_bins, bands, frame_scale_us
        self.sigma, self.hard_rate, self.hard_bin, self.good_times_only, self.whole_frames_only = sigma, hard_rate, hard_bin, good_times_only, whole_frames_only
        self.sources, self.wcs = sources, wcs
        self._made: dict[str, DataFrame] = {}

    def _step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            spark, df = self.events.sparkSession, make()
            path = store.scratch(spark, name)
            df.write.parquet(path)
            self._made[name] = spark.read.schema(df.schema).parquet(path)
        return self._made[name]

    def bad_times(self) -> DataFrame:
        """(timed, start, stop) in microseconds: where the hard rate, in bins of at most ``hard_bin``, is over the limit."""

        def make() -> DataFrame:
            out = None
            # bins are at most as long as a frame, so there are as many curves as different ones
            for length in sorted({min(t, self.hard_bin) for t in self.time_bins}):
                us = length * self.scale
                found = intervals.bad_times(intervals.high_energy_curve(self.events, us), self.hard_rate)
                bins = F.explode(F.array(*[F.lit(t) for t in self.time_bins if min(t, self.hard_bin) == length])).alias("t_bin")
                one = found.select("obsid", (F.col("start") * us).alias("start"), (F.col("stop") * us).alias("stop"), bins).select(_timed().alias("timed"), "start", "stop")
                out = one if out is None else out.unionByName(one)
            return out

        return self._step("bti", make)

    def frames(self) -> DataFrame:
        """(timed, it, is_bti, is_partial, kept, exposure) of every frame from the first to the last event."""

        def make() -> DataFrame:
            each = self.events.select("obsid", "ccdnr", "t_us", F.explode(F.array(*map(F.lit, self.time_bins))).alias("t_bin"))
            # one scan for all frame lengths
            hits = each.select(_timed().alias("obsid"), "t_bin", F.expr(f"t_us div (t_bin * {self.scale}L)").alias("it"), "ccdnr").groupBy("obsid", "t_bin", "it", "ccdnr").agg(F.count("*").alias("n"))
            hits = self._step("hits", lambda: hits)
            spans = hits.groupBy("obsid", "t_bin").agg(F.min("it").alias("lo"), F.max("it").alias("hi"))
            edges = spans.select("obsid", "lo", F.col("t_bin"), F.explode(F.sequence("lo", F.col("hi") + 1)).alias("it"))
            bad = intervals.bad_bins(edges.select("obsid", F.col("it").alias("k"), (F.col("it") * F.col("t_bin") * self.scale).alias("t")), self.bad_times().withColumnRenamed("timed", "obsid"))
            in_bad = bad.join(spans, "obsid").select("obsid", (F.col("lo") + F.col("k")).alias("it"), F.lit(True).alias("is_bti")).distinct()
            ccd = cube.bad_ccd_frames_of(hits.select("obsid", "it", "ccdnr", "n")).select("obsid", "it", F.col("is_bad").alias("is_partial"))
            out = ccd.join(in_bad, ["obsid", "it"], "left").withColumn("is_bti", F.coalesce("is_bti", F.lit(False)))
            left_out = (F.col("is_bti") & F.lit(self.good_times_only)) | (F.col("is_partial") & F.lit(self.whole_frames_only))
            exposure = F.when(F.col("is_partial") & F.lit(self.whole_frames_only), 0.0).otherwise(1.0)
            return out.select(F.col("obsid").alias("timed"), "it", "is_bti", "is_partial", (~left_out).alias("kept"), exposure.alias("exposure"))

        return self._step("frames", make)

    def cells(self) -> DataFrame:
        """Occupied cells (obsid: the run, timed, obs, ix, iy, it, n, is_bti) of the frames that count."""

        def make() -> DataFrame:
            every = runs(self.events, self.scale, self.time_bins, self.bands).select(_run().alias("obsid"), _timed().alias("timed"), F.col("obsid").alias("obs"), "ix", "iy", "it", "n")
            return every.join(self.frames().where("kept").select("timed", "it", "is_bti"), ["timed", "it"]).select("obsid", "timed", "obs", "ix", "iy", "it", "n", "is_bti")

        return self._step("cells", make)

    def run_frames(self) -> DataFrame:
        """(obsid: the run, timed, obs, frames, gti, bti, exposed_gti, exposed_bti) of every run with counts."""

        def make() -> DataFrame:
            counts = self.frames().groupBy("timed").agg(
                F.count("*").alias("frames"), F.count_if(~F.col("is_bti")).alias("gti"), F.count_if("is_bti").alias("bti"), F.count_if("is_partial").alias("partial"),
                F.coalesce(F.sum(F.when(~F.col("is_bti"), F.col("exposure"))), F.lit(0.0)).alias("exposed_gti"), F.coalesce(F.sum(F.when(F.col("is_bti"), F.col("exposure"))), F.lit(0.0)).alias("exposed_bti"),
            )
            return self.cells().select("obsid", "timed", "obs").distinct().join(counts, "timed")

        return self._step("run_frames", make)

    def _boxes(self) -> DataFrame:
        return self._step("boxes", lambda: background.box_of(self.cells()))

    def source_mask(self) -> DataFrame:
        """(obsid: the run, ix, iy) of pixels on a known source or far over the others in good times."""

        def make() -> DataFrame:
            good = self.cells().where("not is_bti").groupBy("obsid", "ix", "iy").agg(F.sum("n").alias("total"))
            if self.sources is None:
                listed = good.select("obsid", "ix", "iy").where("false")
            else:
                disks = background.disk_pixels(self.sources).withColumnRenamed("obsid", "obs")
                listed = disks.join(self.run_frames().select("obsid", "obs"), "obs").select("obsid", "ix", "iy")
            return background.masked_sources(good, listed, box=self._boxes())

        return self._step("mask", make)

    def model(self) -> DataFrame:
        """(obsid: the run, is_bti, ix, iy, template, rate): the expectation's part of each pixel with counts, for both kinds of time."""

        def make() -> DataFrame:
            keys = ["obsid", "is_bti", "ix", "iy"]
            image = self._step("images", lambda: self.cells().groupBy(*keys).agg(F.sum("n").alias("total")))
            # both kinds of all runs in one pass: a kind of a run is an image
            name = F.concat_ws("|", "obsid", F.col("is_bti").cast("string"))
            kinds = self.cells().select("obsid", "is_bti").distinct()
            per_kind = lambda df: df.join(kinds, "obsid").withColumn("obsid", name).drop("is_bti")
            template = background.background_template(image.withColumn("obsid", name).drop("is_bti"), per_kind(self.source_mask()), box=per_kind(self._boxes()))
            flat = template.select(F.regexp_extract("obsid", r"^(.*)\|", 1).alias("obsid"), (F.regexp_extract("obsid", r"\|(.*)$", 1) == "true").alias("is_bti"), "ix", "iy", "template")
            flat = self._step("templates", lambda: flat)
            mask = self.source_mask()
            outside = image.join(mask, ["obsid", "ix", "iy"], "left_anti").groupBy("obsid", "is_bti").agg(F.sum("total").alias("outside"))
            # sources shine as in the kind of time that has more frames
            more = self.run_frames().select("obsid", (F.col("gti") <= F.col("bti")).alias("is_bti"), F.when(F.col("gti") > F.col("bti"), F.col("exposed_gti")).otherwise(F.col("exposed_bti")).alias("exposed"))
            shining = image.join(more, ["obsid", "is_bti"]).join(mask, ["obsid", "ix", "iy"], "left_semi").join(flat, keys).join(outside, ["obsid", "is_bti"], "left")
            rate = F.greatest(F.lit(0.0), F.col("total") - F.col("template") * F.coalesce("outside", F.lit(0))) / F.col("exposed")
            rates = shining.where("exposed > 0").select("obsid", "ix", "iy", rate.alias("rate"))
            return flat.join(rates, ["obsid", "ix", "iy"], "left").select(*keys, "template", F.coalesce("rate", F.lit(0.0)).alias("rate"))

        return self._step("model", make)

    def background_curve(self) -> DataFrame:
        """(obsid: the run, it, is_bti, exposure, outside): counts outside sources in each frame with counts."""

        def make() -> DataFrame:
            masked = self.source_mask().select("obsid", "ix", "iy").distinct().withColumn("on", F.lit(True))
            sums = self.cells().join(masked, ["obsid", "ix", "iy"], "left").groupBy("obsid", "timed", "it", "is_bti").agg(F.coalesce(F.sum(F.when(F.col("on").isNull(), F.col("n"))), F.lit(0)).alias("outside"))
            return sums.join(self.frames().select("timed", "it", "exposure"), ["timed", "it"]).select("obsid", "it", "is_bti", "exposure", "outside")

        return self._step("curve", make)

    def scored(self) -> DataFrame:
        """(obsid: the run, ix, iy, it, n, mu): occupied cells, and those without counts that are a dip."""

        def make() -> DataFrame:
            model, curve = self.model(), self.background_curve()
            mu = F.col("template") * F.col("outside") + F.col("rate") * F.col("exposure")
            at = ["obsid", "ix", "iy", "it"]
            held = self.cells().join(model, ["obsid", "is_bti", "ix", "iy"]).join(curve.drop("is_bti"), ["obsid", "it"]).select(*at, "n", mu.alias("mu"))
            # without counts the factor is e^mu - 1: only where more than this is expected is none a dip
            least = math.log1p(10 ** threshold("eclipse", self.sigma)) - 0.1
            most = curve.groupBy("obsid", "is_bti").agg(F.max("outside").alias("most"))
            needed = F.when(F.col("rate") > least, 0.0).when(F.col("template") > 0, (F.lit(least) - F.col("rate")) / F.col("template"))
            bright = model.join(most, ["obsid", "is_bti"]).withColumn("needed", needed).where("needed <= most")
            # frames by the power of two of their counts: a pixel meets only those that can be enough
            power = lambda c: F.floor(F.log2(c + 1.0)).cast("int")
            dealt = bright.withColumn("power", F.explode(F.sequence(power(F.col("needed")), power(F.col("most")))))
            empty = dealt.join(curve.withColumn("power", power(F.col("outside"))), ["obsid", "is_bti", "power"]).withColumn("mu", mu).where(F.col("mu") > least)
            return held.unionByName(empty.select(*at, F.lit(0).cast("long").alias("n"), "mu").join(self.cells(), at, "left_anti"))

        return self._step("scored", make)

    def alerts(self) -> DataFrame:
        return self._step("alerts", lambda: significant(self.scored(), self.limits).where("is_peak or is_eclipse"))

    def alert_events(self) -> DataFrame:
        """Events in the cells of alerts, with the run and the cell of each."""
        found = self.alerts().select(F.col("obsid").alias("runid"), "ix", "iy", "it")
        return _dealt(self.events, self.scale, self.time_bins, self.bands).withColumn("runid", _run()).drop("t_bin", "e_lo", "e_hi").join(found, ["runid", "ix", "iy", "it"], "left_semi")

    def regions(self) -> DataFrame:
        """Connected pixels with an alert, measured on the image of all counts that are left; on the sky too where ``wcs`` is known."""

        def make() -> DataFrame:
            image = self.cells().groupBy("obsid", "ix", "iy").agg(F.sum("n").alias("total"))
            hit = self.alerts().select("obsid", "ix", "iy").distinct().join(image, ["obsid", "ix", "iy"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
            found = regions.properties(regions.components(hit)).withColumnRenamed("obsid", "runid")
            found = found.withColumn("detid", F.concat_ws("_", "runid", F.col("label").cast("string")))
            if self.wcs is None:
                return found
            placed = found.join(self.run_frames().select(F.col("obsid").alias("runid"), F.col("obs").alias("obsid")), "runid").join(self.wcs, "obsid", "left")
            constants = [(F.col(f"{c}_x"), F.col(f"{c}_y")) for c in ("crpix", "cdelt", "crval")]
            ra, dec = geometry.pixel_to_sky(F.col("weighted_0"), F.col("weighted_1"), *constants)
            return placed.select(*found.columns, ra.alias("ra_deg"), dec.alias("dec_deg"))

        return self._step("regions", make)

    def light_curves(self) -> DataFrame:
        """(runid, label, it, n, mu, is_bti, exposure) over each region's box, in every frame that counts.

        mu is a sum of two products, so a region's templates and rates are summed
        once and meet the frames; no cell is expanded.
        """

        def make() -> DataFrame:
            boxes = self.regions().select(F.col("runid").alias("obsid"), "label", "bbox_0", "bbox_1", "bbox_2", "bbox_3")
            counts = cube.light_curves(self.cells(), boxes)
            inside = cube.box_pixels(boxes)
            parts = self.model().join(inside, ["obsid", "ix", "iy"]).groupBy("obsid", "label", "is_bti").agg(F.sum("template").alias("template"), F.sum("rate").alias("rate"))
            frames = self.run_frames().select("obsid", "timed").join(self.frames().where("kept").select("timed", "it", "is_bti", "exposure"), "timed").drop("timed")
            every = boxes.select("obsid", "label").join(frames, "obsid").join(self.background_curve().select("obsid", "it", "outside"), ["obsid", "it"], "left")
            joined = every.join(parts, ["obsid", "label", "is_bti"], "left").join(counts, ["obsid", "label", "it"], "left")
            # a frame without any counts has no expectation
            mu = F.when(F.col("outside").isNotNull(), F.col("template") * F.col("outside") + F.col("rate") * F.col("exposure"))
            return joined.select(F.col("obsid").alias("runid"), "label", "it", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(mu, F.lit(0.0)).alias("mu"), "is_bti", "exposure")

        return self._step("light_curves", make)

    def features(self) -> DataFrame:
        """The catalogue's features of every region's light curve."""
        t_bin = F.split_part("runid", F.lit("_"), F.lit(3)).cast("int")
        return self._step("features", lambda: features.catalogue_features(self.light_curves(), t_bin))

    def catalogue(self, excluded: Sequence[str] = (), crowded: int = 20, hot: DataFrame | None = None) -> DataFrame:
        """The 27 columns of every detection: place, unique source, features of its light curve and flags.

        ``hot`` are detections (detid) on hot pixels; ``excluded`` observations.
        Needs ``wcs``, as sources are unique by their place on the sky.
        """
        found = ranks.numbered(self.regions(), "detid", "region")
        unique = crossmatch.numbered(crossmatch.cluster(found.select("region", "ra_deg", "dec_deg")))
        # a region that several clusters hold belongs to the first
        of_region = unique.select("cluster_label", F.explode("members").alias("region")).groupBy("region").agg(F.min("cluster_label").alias("cluster_label"))
        measured = found.join(of_region, "region").join(self.features(), ["runid", "label"])
        measured = measured.withColumns({"intensity": F.col("n_max"), "x_img": F.col("weighted_0"), "y_img": F.col("weighted_1")})
        flagged = filters.quality_flags(measured, list(excluded) or [""], crowded)
        is_hot = F.lit(False)
        if hot is not None:
            flagged = flagged.join(hot.select("detid").distinct().withColumn("_hot", F.lit(True)), "detid", "left")
            is_hot = F.coalesce("_hot", F.lit(False))
        flags = flagged.select("detid", F.col("low_counts").alias("filt_tbin_5_n_l_5"), F.col("excluded").alias("filt_exclude_obsid"), filters.five_sigma().passed().alias("filt_5sig"), F.col("crowded_run").alias("filt_g_20_detections"), is_hot.alias("filt_hot_pixel"))
        return catalogues.full_detections(measured, measured.select("detid", *catalogues.CURVE_COLUMNS), flags)

    def info(self) -> DataFrame:
        """Totals of every run."""
        cells = self.cells().groupBy(F.col("obsid").alias("runid")).agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_events"), F.max("n").alias("max_n"))
        found = self.alerts().groupBy(F.col("obsid").alias("runid")).agg(F.count_if("is_peak").alias("n_peaks"), F.count_if("is_eclipse").alias("n_eclipses"))
        of_regions = self.regions().groupBy("runid").agg(F.count("*").alias("n_regions"))
        count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return cells.join(found, "runid", "left").join(of_regions, "runid", "left").select("runid", "n_cells", "n_events", "max_n", count("n_peaks"), count("n_eclipses"), count("n_regions"))

    def cube_info(self) -> DataFrame:
        """Shape and kinds of frames of every run's cube."""
        sides = self._boxes().select("obsid", (F.col("x1") - F.col("x0") + 1).alias("n_x"), (F.col("y1") - F.col("y0") + 1).alias("n_y"))
        shares = [(F.col(k) / F.col("frames")).alias(f"{k}_share") for k in ("gti", "bti")]
        return self.run_frames().join(sides, "obsid").select(F.col("obsid").alias("runid"), "n_x", "n_y", F.col("frames").alias("n_frames"), F.col("gti").alias("n_gti"), F.col("bti").alias("n_bti"), F.col("partial").alias("n_partial"), *shares)

    def evt_info(self) -> DataFrame:
        """Counts, times and energies of every observation's events."""
        return self.events.groupBy(F.col("obsid").alias("runid")).agg(F.count("*").alias("n_events"), F.min("t_us").alias("t_min"), F.max("t_us").alias("t_max"), F.min("pi").alias("pi_min"), F.max("pi").alias("pi_max"), F.countDistinct("ccdnr").alias("n_ccd"))

    def obs_info(self) -> DataFrame:
        """Runs, regions and bad times of every observation."""
        of_run = self.run_frames().select("obs", "obsid").join(self.info().withColumnRenamed("runid", "obsid"), "obsid")
        return of_run.groupBy(F.col("obs").alias("runid")).agg(F.count("*").alias("n_runs"), F.sum("n_peaks").alias("n_peaks"), F.sum("n_eclipses").alias("n_eclipses"), F.sum("n_regions").alias("n_regions"))

    def save(self, root: str) -> None:
        """Every table of the runs, in one place."""
        tables = {
            "alerts": self.alerts().withColumnRenamed("obsid", "runid"), "regions": self.regions(), "light_curves": self.light_curves(), "run_info": self.info(), "bti": self.bad_times(),
            "cube_info": self.cube_info(), "evt_info": self.evt_info(), "obs_info": self.obs_info(),
        }
        for name in store.TABLES:
            store.save(tables[name], root, name)
