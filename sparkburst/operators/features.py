"""Features of light curves: rows (runid, label, it, n, mu), one frame each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.bayes import ECLIPSE_3, ECLIPSE_5, PEAK_3, PEAK_5, log_eclipse, log_peak, sigma_of_factor
from .ranks import summed_before

KEY = ["runid", "label"]


def by_time(*columns: str) -> WindowSpec:
    """Frames of a label by time; where curves share a label, those of one time by ``columns``, so that every run takes them alike."""
    return Window.partitionBy(*KEY).orderBy("it", *columns)


def whole() -> WindowSpec:
    return Window.partitionBy(*KEY)


def moments(curves: DataFrame, column: str = "n") -> DataFrame:
    c = F.col(column)
    return curves.groupBy(*KEY).agg(
        F.count("*").alias("len"), F.min(c).alias("min_n"), F.max(c).alias("max_n"), F.avg(c).alias("mean_n"), F.stddev_samp(c).alias("std_n"), F.sum(c).alias("sum_n"), F.skewness(c).alias("skew_n"), F.kurtosis(c).alias("kurt_n")
    )


def significant_bins(curves: DataFrame, thresholds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Twelve counts: bins over 3 and 5 sigma, of peaks and eclipses, in all, bad and good times."""
    cuts = thresholds or {"peak": (PEAK_3, PEAK_5), "eclipse": (ECLIPSE_3, ECLIPSE_5)}
    aggs = []
    for kind, (three, five) in cuts.items():
        for sigma, cut in ((3, three), (5, five)):
            over = F.col(f"b_{kind}") > cut
            aggs += [
                F.count_if(over).alias(f"n_{sigma}_sig_{kind}_bins"),
                F.count_if(over & F.col("bti")).alias(f"n_{sigma}_sig_{kind}_bins_bti"),
                F.count_if(over & ~F.col("bti")).alias(f"n_{sigma}_sig_{kind}_bins_gti"),
            ]
    return curves.groupBy(*KEY).agg(*aggs)


def local_maxima(curves: DataFrame, least: float, column: str = "n") -> DataFrame:
    """Number of local maxima of at least ``least``; a plateau is one, the ends are none."""
    changed = F.coalesce(F.col(column) != F.lag(column).over(by_time(column)), F.lit(True))
    runs = curves.withColumn("_c", changed).where("_c")
    before, after = F.lag(column).over(by_time(column)), F.lead(column).over(by_time(column))
    peak = (F.col(column) > before) & (F.col(column) > after) & (F.col(column) >= least)
    return runs.withColumn("_p", F.coalesce(peak, F.lit(False))).groupBy(*KEY).agg(F.count_if("_p").alias("n_maxima"))


def distant_peaks(curves: DataFrame, least: float, spacing: int, column: str = "n") -> DataFrame:
    """Number of groups of bins over ``least`` that lie more than ``spacing`` frames apart."""
    over = curves.where(F.col(column) > least).withColumn("_gap", F.col("it") - F.lag("it").over(by_time()))
    found = over.groupBy(*KEY).agg((F.count_if(F.col("_gap") > spacing) + 1).alias("n_distant"))
    return curves.select(*KEY).distinct().join(found, KEY, "left").withColumn("n_distant", F.coalesce("n_distant", F.lit(0).cast("long")))


def crossings(curves: DataFrame, level: float, column: str = "n") -> DataFrame:
    over = (F.col(column) > level).cast("int")
    moved = curves.withColumn("_o", over).withColumn("_d", F.abs(F.col("_o") - F.lag("_o").over(by_time(column))))
    return moved.groupBy(*KEY).agg((F.coalesce(F.sum("_d"), F.lit(0)) / 2).alias("n_crossings"))


def largest_peak(curves: DataFrame, column: str = "n") -> DataFrame:
    """Frame of the first maximum, whether it is the first or last, and whether both neighbours are zero; the ends meet."""
    place = F.struct("it", column)
    first, last = F.min_by(column, place).over(whole()), F.max_by(column, place).over(whole())
    near = curves.withColumn("_b", F.coalesce(F.lag(column).over(by_time(column)), last)).withColumn("_a", F.coalesce(F.lead(column).over(by_time(column)), first))
    ends = near.withColumn("_lo", F.min("it").over(whole())).withColumn("_hi", F.max("it").over(whole()))
    best = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(column), "it", "_b", "_a"))
    return ends.withColumn("_r", best).where("_r = 1").select(
        *KEY, F.col("it").alias("idx"), F.col(column).alias("peak_n"), (F.col("it") == F.col("_lo")).alias("is_first"), (F.col("it") == F.col("_hi")).alias("is_last"), ((F.col("_b") == 0) & (F.col("_a") == 0)).alias("isolated")
    )


def ks_statistic(curves: DataFrame, a: str = "n", b: str = "mu") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between two columns of each light curve."""
    both = curves.select(*KEY, F.col(a).cast("double").alias("v"), F.lit(1).alias("one")).unionByName(curves.select(*KEY, F.col(b).cast("double").alias("v"), F.lit(0).alias("one")))
    # a value counts as often as it occurs, so equal ones are one row
    values = both.groupBy(*KEY, "v").agg(F.sum("one").alias("_a"), F.count("*").alias("_c"))
    upto = Window.partitionBy(*KEY).orderBy("v")
    cdf = values.withColumn("_x", F.sum("_a").over(upto)).withColumn("_y", F.sum("_c").over(upto) - F.sum("_a").over(upto))
    sized = cdf.withColumn("_m", F.sum("_a").over(whole()))
    return sized.groupBy(*KEY).agg(F.max(F.abs(F.col("_x") / F.col("_m") - F.col("_y") / F.col("_m"))).alias("ks"), F.max("_m").alias("len"))


def ks_probability(ks: Column, n: Column) -> Column:
    """Asymptotic p-value of a two-sample distance with n values on each side: a hundred terms of the alternating series."""
    lam = ks * F.sqrt(n / 2)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def kuiper(curves: DataFrame) -> DataFrame:
    """Largest excess and deficit of the cumulated counts against a uniform rate."""
    share = F.sum("n").over(by_time()) / F.sum("n").over(whole()) - F.row_number().over(by_time()) / F.count("*").over(whole())
    return curves.withColumn("_d", share).groupBy(*KEY).agg(F.max("_d").alias("d_plus"), F.min("_d").alias("d_minus"))


def from_start(curves: DataFrame) -> DataFrame:
    return curves.withColumn("t0", F.col("it") - F.min("it").over(whole()))


def end_to_end(curves: DataFrame) -> DataFrame:
    """Light curves of several runs put one after the other, in the order of runid."""
    started = from_start(curves)
    spans = curves.groupBy(*KEY).agg((F.max("it") - F.min("it")).alias("_t")).groupBy("runid").agg(F.max("_t").alias("span"))
    shifts = summed_before(spans, "runid", "span", "shift").select("runid", "shift")
    return started.join(shifts, "runid").withColumn("t_shifted", F.col("t0") + F.col("shift"))


def paired_t(curves: DataFrame, frames: int) -> DataFrame:
    """t of the differences mu - n over the first frames."""
    d = F.col("mu") - F.col("n")
    first = from_start(curves).where(F.col("t0") < frames).groupBy(*KEY).agg(F.count("*").alias("m"), F.avg(d).alias("mean_d"), F.stddev_samp(d).alias("sd"))
    return first.where("sd > 0").select(*KEY, "m", (F.col("mean_d") / (F.col("sd") / F.sqrt("m"))).alias("t"))


def near_box(cells: DataFrame, reach: int = 5) -> DataFrame:
    """For every occupied cell: counts of its 3 x 3 box and of the rest of the frame, and both within ``reach`` frames."""
    near = F.explode(F.expr("flatten(transform(array(-1,0,1), a -> transform(array(-1,0,1), b -> struct(a as dx, b as dy))))"))
    moved = cells.select("obsid", "ix", "iy", "it", "n", near.alias("d")).select("obsid", (F.col("ix") + F.col("d.dx")).alias("ix"), (F.col("iy") + F.col("d.dy")).alias("iy"), "it", "n")
    box = moved.groupBy("obsid", "ix", "iy", "it").agg(F.sum("n").alias("n_box"))
    frame = cells.groupBy("obsid", "it").agg(F.sum("n").alias("n_frame"))
    window = Window.partitionBy("obsid").orderBy("it").rangeBetween(-reach, reach)
    wide = frame.withColumn("n_around", F.sum("n_frame").over(window))
    pixel = Window.partitionBy("obsid", "ix", "iy").orderBy("it").rangeBetween(-reach, reach)
    boxed = box.withColumn("box_around", F.sum("n_box").over(pixel))
    return cells.select("obsid", "ix", "iy", "it").join(boxed, ["obsid", "ix", "iy", "it"]).join(wide, ["obsid", "it"]).select(
        "obsid", "ix", "iy", "it", "n_box", (F.col("n_frame") - F.col("n_box")).alias("n_rest"), "box_around", (F.col("n_around") - F.col("box_around")).alias("rest_around")
    )


def spurious(near: DataFrame, reach: int = 5, margin: float = 0.25) -> DataFrame:
    """Flags rises and falls of a box that the rest of the frame shares, against the mean of the frames around.

    A rise is spurious if the rest rises too and the box by less than ``margin``
    more; a fall if the rest falls too, by less than ``margin`` more than the box.
    """
    mean = lambda around, own: (F.col(around) - F.col(own)) / (2.0 * reach)
    box, rest = mean("box_around", "n_box"), mean("rest_around", "n_rest")
    up_box, up_rest = (F.col("n_box") - box) / F.nullif(box, F.lit(0.0)), (F.col("n_rest") - rest) / F.nullif(rest, F.lit(0.0))
    peak = (up_rest > 0) & (up_box - up_rest < margin)
    eclipse = (F.col("n_rest") < rest) & (up_box - up_rest < margin)
    return near.withColumn("spurious_peak", F.coalesce(peak, F.lit(False))).withColumn("spurious_eclipse", F.coalesce(eclipse, F.lit(False)))


#: Factors over which a bin counts as a peak or an eclipse, and by frame length the bins between peaks.
PEAK_BIN, ECLIPSE_BIN = 6.4, 5.5
SPACING = {5: 1000, 50: 100, 200: 5}


def catalogue_features(curves: DataFrame, t_bin: Column, spacing: int = 5) -> DataFrame:
    """What the catalogue of detections holds of every light curve (runid, label, it, n, mu, is_bti).

    Moments of the counts, the share of bad time, the sigma of the greatest factors,
    peaks far enough apart (``SPACING`` bins for its frame lengths, else
    ``spacing``), and the two-sample probability of counts and expectation.
    """
    kinds = curves.select("n", "mu").distinct()
    kinds = kinds.withColumn("b_peak", log_peak(F.col("n"), F.col("mu"))).withColumn("b_eclipse", log_eclipse(F.col("n"), F.col("mu")))
    bins = curves.join(kinds, ["n", "mu"])
    apart = F.lit(spacing)
    for length, least in SPACING.items():
        apart = F.when(t_bin == length, least).otherwise(apart)
    stats = bins.groupBy(*KEY).agg(
        F.max("n").alias("n_max"), F.min("n").alias("n_min"), F.sum("n").alias("n_sum"), F.avg("n").alias("n_mean"), F.stddev_samp("n").alias("n_std"), F.skewness("n").alias("n_skew"), F.kurtosis("n").alias("n_kurt"),
        F.max("b_peak").alias("_p"), F.max("b_eclipse").alias("_e"), (F.count_if("is_bti") / F.count("*")).alias("ratio_bti"), F.count("*").alias("_len"),
    )
    over = bins.where((F.col("b_peak") > PEAK_BIN) | (F.col("b_eclipse") > ECLIPSE_BIN)).withColumn("_gap", F.col("it") - F.lag("it").over(by_time()))
    peaks = over.withColumn("_far", F.col("_gap") > apart).groupBy(*KEY).agg((F.count_if("_far") + 1).alias("n_peaks"))
    apart_of = stats.join(peaks, KEY, "left").join(ks_statistic(curves).select(*KEY, "ks"), KEY).withColumn("bin_min_between_peaks", apart)
    sigma = lambda c, up: sigma_of_factor(F.round(c, 9), F.lit(up))
    return apart_of.select(
        *KEY, "n_max", "n_min", "n_sum", "n_mean", "n_std", "n_skew", "n_kurt", sigma("_p", True).alias("sigma_max_B_peak"), sigma("_e", False).alias("sigma_max_B_eclipse"), "ratio_bti", "bin_min_between_peaks",
        F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"), ks_probability(F.col("ks"), F.col("_len")).alias("ks_pval"), F.col("_p").alias("b_peak_max"), F.col("_e").alias("b_eclipse_max"),
    )


def ks_poisson(curves: DataFrame, column: str = "n") -> DataFrame:
    """One-sample Kolmogorov-Smirnov distance of each light curve to the Poisson law of its mean, with the asymptotic p-value."""
    counts = curves.groupBy(*KEY, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    level = curves.groupBy(*KEY).agg(F.avg(column).alias("m"), F.count("*").alias("len"))
    upto = Window.partitionBy(*KEY).orderBy("v")
    rows = counts.join(level, KEY).withColumn("k", F.sum("c").over(upto))
    # the law's share up to v, by logarithms that are summed as the fold goes on
    start = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("sum"))
    cdf = F.when(F.col("m") > 0, F.exp(-F.col("m")) * F.when(F.col("v") > 0, F.aggregate(F.sequence(F.lit(1), F.col("v").cast("int")), start, lambda s, k: F.struct((s["log"] + F.log(F.col("m")) - F.log(k.cast("double"))).alias("log"), (s["sum"] + F.exp(s["log"] + F.log(F.col("m")) - F.log(k.cast("double")))).alias("sum")), lambda s: s["sum"])).otherwise(1.0)).otherwise(1.0)
    apart = F.greatest(F.col("k") / F.col("len") - F.col("cdf"), F.col("cdf") - (F.col("k") - F.col("c")) / F.col("len"))
    out = rows.withColumn("cdf", cdf).groupBy(*KEY).agg(F.max(apart).alias("ks"), F.max("len").alias("len"))
    return out.withColumn("p", ks_probability(F.col("ks"), 2 * F.col("len")))


def t_probability(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with whole degrees of freedom: the finite series in the angle whose tangent is t over their root."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    # the terms' factors are (2k) / (2k + 1) for odd, (2k - 1) / (2k) for even degrees of freedom
    many = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    ratio = lambda k: F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k)) * c2
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    series = F.when(many > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), start, lambda s, k: F.struct((s["t"] * ratio(k)).alias("t"), (s["s"] + s["t"] * ratio(k)).alias("s")), lambda s: s["s"])).otherwise(1.0)
    inside = F.when(odd, 2 / math.pi * (angle + F.when(df > 1, F.sin(angle) * F.cos(angle) * series).otherwise(0.0))).otherwise(F.sin(angle) * series)
    return F.greatest(F.lit(0.0), 1 - inside)


def convolved(curves: DataFrame, template: list[float], column: str = "n") -> DataFrame:
    """Each frame's sum of a template's weights times the frames that end with it; frames before the start count as zero."""
    parts = [w * F.coalesce(F.lag(column, k).over(by_time(column)), F.lit(0)) for k, w in enumerate(template)]
    return curves.withColumn("convolved", sum(parts[1:], parts[0]))
