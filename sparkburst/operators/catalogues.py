"""Detection and unique-source catalogues, summaries and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iau_name
from .crossmatch import NO_MATCH, within

#: Units and descriptions that a catalogue's columns carry as metadata.
COLUMNS = {
    "ra_deg": ("deg", "right ascension"),
    "dec_deg": ("deg", "declination"),
    "intensity": ("counts", "total counts of the region"),
    "area_bbox": ("pixels", "area of the bounding box"),
    "e_lo": ("keV", "lower end of the band"),
    "e_hi": ("keV", "upper end of the band"),
    "t_bin": ("s", "length of a frame"),
}


#: The measures of a light curve that the full catalogue of detections carries, behind ``lc_``.
CURVE_COLUMNS = ("n_max", "n_min", "n_sum", "n_mean", "n_std", "n_skew", "n_kurt", "sigma_max_B_peak", "sigma_max_B_eclipse", "ratio_bti", "bin_min_between_peaks", "n_peaks", "ks_pval")
#: Its quality flags.
FLAG_COLUMNS = ("filt_tbin_5_n_l_5", "filt_exclude_obsid", "filt_5sig", "filt_g_20_detections", "filt_hot_pixel")
#: By prefix of the full catalogue of sources, what it takes from each external catalogue.
EXTERNAL_COLUMNS = {
    "simbad": ("main_id", "main_type", "ra", "dec", "SEP_ARCSEC"),
    "gaia": ("DR3Name", "RAdeg", "DEdeg", "SEP_ARCSEC", "Gmag", "BPmag", "RPmag", "Dist", "Teff", "VarFlag"),
    "SUSS6": ("XMMOM", "ID", "RAJ2000", "DEJ2000", "SEP_ARCSEC", "Nobs", "UVW2mAB", "UVM2mAB", "UVW1mAB", "UmAB", "BmAB", "VmAB"),
    "DR14": ("IAUNAME", "SRCID", "SC_RA", "SC_DEC", "SC_POSERR", "SC_EP_8_FLUX", "SEP_ARCSEC", "SC_VAR_FLAG"),
}


def full_detections(regions: DataFrame, features: DataFrame, flags: DataFrame) -> DataFrame:
    """The 27 columns of every detection: position, extraction region, light curve and flags.

    ``features`` and ``flags`` are keyed by detid and have the columns named in
    ``CURVE_COLUMNS`` and ``FLAG_COLUMNS``; the name is that of the unique source.
    """
    source = regions.groupBy("cluster_label").agg(iau_name(F.avg("ra_deg"), F.avg("dec_deg")).alias("srcid"))
    placed = regions.select("detid", "cluster_label", "ra_deg", "dec_deg", "x_img", "y_img", "area_bbox", "intensity_mean")
    joined = placed.join(source, "cluster_label").join(features, "detid", "left").join(flags, "detid", "left")
    own = ["detid", "srcid", F.col("cluster_label").alias("unique_reg_id"), "ra_deg", "dec_deg", F.col("x_img").alias("X"), F.col("y_img").alias("Y"), "area_bbox", (F.col("intensity_mean") / F.col("area_bbox")).alias("mean_pixel_intensity")]
    return described(joined.select(*own, *[F.col(c).alias(f"lc_{c}") for c in CURVE_COLUMNS], *FLAG_COLUMNS))


def full_sources(regions: DataFrame, matches: dict[str, DataFrame], radius_arcsec: float = 20.0) -> DataFrame:
    """The 40 columns of every unique source: its own, and of four external catalogues.

    ``matches`` has by prefix the closest row of a catalogue for each
    cluster_label.  A separation that stands for no match is null; of the last
    catalogue everything beyond the radius is null, its number 0 and its flag false.
    """
    own = regions.groupBy(F.col("cluster_label").alias("region_num")).agg(iau_name(F.avg("ra_deg"), F.avg("dec_deg")).alias("srcid"), F.avg("ra_deg").alias("ra_deg"), F.avg("dec_deg").alias("dec_deg"), F.count("*").alias("n_detections"))
    for prefix, names in EXTERNAL_COLUMNS.items():
        found = matches[prefix].select(F.col("cluster_label").alias("region_num"), *[F.col(c).alias(f"{prefix}_{c}") for c in names])
        own = own.join(found, "region_num", "left")
        sep = F.col(f"{prefix}_SEP_ARCSEC")
        if prefix != "DR14":
            own = own.withColumn(f"{prefix}_SEP_ARCSEC", F.when(sep != NO_MATCH, sep))
            continue
        near = F.coalesce(sep <= radius_arcsec, F.lit(False))
        instead = {"SC_VAR_FLAG": F.lit(False), "SRCID": F.lit(0).cast("long")}
        own = own.withColumns({f"{prefix}_{c}": F.when(near, F.col(f"{prefix}_{c}")).otherwise(instead.get(c, F.lit(None))) for c in names})
    return described(own)


def described(df: DataFrame) -> DataFrame:
    for name, (unit, comment) in COLUMNS.items():
        if name in df.columns:
            df = df.withMetadata(name, {"unit": unit, "comment": comment})
    return df


def detection_catalogue(regions: DataFrame) -> DataFrame:
    parts = F.split("runid", "_")
    return described(
        regions.select(
            "detid", "obsid", "t_bin", parts[3].cast("double").alias("e_lo"), parts[4].cast("double").alias("e_hi"), "label", "region", "intensity", "area_bbox", "ra_deg", "dec_deg", "cluster_label",
            iau_name(F.col("ra_deg"), F.col("dec_deg")).alias("name"),
        )
    )


def unique_catalogue(regions: DataFrame, wrap_safe: bool = False) -> DataFrame:
    """One row per cluster.  ``wrap_safe`` averages right ascension on the circle."""
    r = F.radians("ra_deg")
    ra = F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0)) if wrap_safe else F.avg("ra_deg")
    out = regions.groupBy("cluster_label").agg(
        F.min("region").alias("first_region"), F.count("*").alias("n_detections"), F.round(ra, 9).alias("ra_deg"), F.round(F.avg("dec_deg"), 9).alias("dec_deg"), F.round(F.avg("intensity"), 6).alias("mean_total_counts"), F.round(F.avg("area_bbox"), 6).alias("mean_area")
    )
    return described(out.withColumn("name", iau_name(F.col("ra_deg"), F.col("dec_deg"))))


def masked_matches(sources: DataFrame, pairs: DataFrame, radius_arcsec: float) -> DataFrame:
    """Each source's closest match; beyond the radius its columns are null and the flag is false."""
    order = Window.partitionBy("cluster_label").orderBy("sep", "cat_id")
    best = pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("cluster_label", "cat_id", "sep")
    near = F.col("sep") <= radius_arcsec
    return sources.join(best, "cluster_label", "left").select(
        "cluster_label", F.when(near, F.col("cat_id")).alias("cat_id"), F.when(near, F.col("sep")).alias("sep_arcsec"), F.coalesce(near, F.lit(False)).alias("has_match")
    )


def external_comparison(regions: DataFrame, catalogue: DataFrame, radius_arcsec: float, cuts: dict[str, float]) -> DataFrame:
    """Regions and observations matched to a catalogue, for each significance and for all or variable counterparts."""
    strong = regions.select("region", "obsid", F.explode(F.filter(F.array(*[F.when(F.col("b_peak_max") > c, F.lit(s)) for s, c in cuts.items()]), lambda x: x.isNotNull())).alias("sigma"))
    kinds = catalogue.select("cat_id", F.explode(F.when(F.col("var_flag"), F.array(F.lit("Full"), F.lit("Variable"))).otherwise(F.array(F.lit("Full")))).alias("kind"))
    pairs = within(regions, catalogue, radius_arcsec).select("region", "cat_id")
    return strong.join(pairs, "region").join(kinds, "cat_id").groupBy("sigma", "kind").agg(F.countDistinct("region").alias("n_regions"), F.countDistinct("obsid").alias("n_obsids"))


def observation_info(regions: DataFrame) -> DataFrame:
    return regions.groupBy("obsid").agg(F.min("runid").alias("first_run"), F.count("*").alias("n_regions"), F.countDistinct("runid").alias("n_runs"), F.max("intensity").alias("max_intensity"))


def region_summary(regions: DataFrame, cluster_label: int) -> dict[str, DataFrame]:
    """The tables that a page on one unique source shows."""
    mine = regions.where(F.col("cluster_label") == cluster_label)
    return {
        "detections": mine.select("region", "runid", "label", "cluster_label", "intensity"),
        "source": unique_catalogue(mine),
        "observations": observation_info(regions.join(mine.select("obsid").distinct(), "obsid", "left_semi")),
    }


def parsed_identifiers(df: DataFrame, column: str = "detid") -> DataFrame:
    parts = F.split(column, "_")
    return df.select(column, parts[0].alias("obsid"), parts[2].cast("int").alias("t_bin"), parts[5].alias("label"), F.regexp_extract(column, r"(\d{10})", 1).alias("obs"))


def tuple_keys(df: DataFrame, column: str) -> DataFrame:
    """runid and label of keys that stand as text of the form ``('runid', 'label')``; null where they do not."""
    part = lambda k: F.nullif(F.regexp_extract(column, r"^\('([^']*)',\s*'?([^')]*)'?\)$", k), F.lit(""))
    return df.withColumn("runid", part(1)).withColumn("label", part(2))


def small_regions(regions: DataFrame, most: int = 36) -> DataFrame:
    """Regions whose box is no larger than ``most`` pixels."""
    return regions.where(F.col("area_bbox") <= most)


def as_rows(info: DataFrame, key: str) -> DataFrame:
    """One key-value row per column of a table of scalars."""
    values = [c for c in info.columns if c != key]
    return info.select(key, *[F.col(c).cast("string").alias(c) for c in values]).unpivot(key, values, "key", "value")


def as_columns(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The reverse of ``as_rows``."""
    return rows.groupBy(key).pivot("key", names).agg(F.first("value"))
