"""Queries on filters, catalogues, statistics, views, learning and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogues as K
from ..operators import crossmatch as C
from ..operators import filters as P
from ..operators import learning, simulation
from ..operators import statistics as S
from ..sources import adapters as A
from ..sources import store
from ..streaming import live
from .cube_queries import cells_of
from .oracle import put
from .views import Results

REGISTER: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTER[f.__name__] = (f, sql)
        return f

    return add


def measured(s, d):
    """Regions with the columns that the predicates look at."""
    r = A.regions(s, d)
    return r.withColumns({
        "intensity_mean": F.col("intensity") / 100, "sigma_max_peak": (F.col("region") % 8).cast("double"), "sigma_max_eclipse": (F.col("region") % 6).cast("double"),
        "b_peak_max": (F.col("region") % 17).cast("double"), "b_eclipse_max": (F.col("region") % 13).cast("double"), "n_max": F.col("region") % 40, "bccd_ratio": (F.col("region") % 11) / 10,
        "length": F.col("region") % 300, "n_3_sig_peak_bins_gti": F.col("region") % 4, "sep_arcsec": (F.col("region") % 90).cast("double"), "var_flag": F.col("region") % 3 == 0, "cluster_label": F.expr("region div 2"),
    })


MEASURED = """SELECT *, intensity / 100.0::DOUBLE AS intensity_mean, (region % 8)::DOUBLE AS sigma_max_peak, (region % 6)::DOUBLE AS sigma_max_eclipse, (region % 17)::DOUBLE AS b_peak_max, (region % 13)::DOUBLE AS b_eclipse_max,
    region % 40 AS n_max, (region % 11) / 10.0::DOUBLE AS bccd_ratio, region % 300 AS length, region % 4 AS n_3_sig_peak_bins_gti, (region % 90)::DOUBLE AS sep_arcsec, region % 3 = 0 AS var_flag, region // 2 AS cluster_label FROM regions"""

#: name -> (predicate, its SQL)
PREDICATES = {
    "q_filter_multiple_detections": (P.multiple_detections(10), "(SELECT count(*) FROM m o WHERE o.obsid = m.obsid) < 10"),
    "q_filter_time_bin": (P.time_bin(50), "contains(runid, '_50_')"),
    "q_filter_energy_range": (P.energy_range(0.2, 2.0), "regexp_matches(runid, '0.2_2.0')"),
    "q_filter_bright": (P.below("intensity_mean", 50), "intensity_mean < 50"),
    "q_filter_area": (P.below("area_bbox", 12), "area_bbox < 12"),
    "q_filter_sigma_peak": (P.above("sigma_max_peak", 3), "sigma_max_peak > 3"),
    "q_filter_sigma_eclipse": (P.above("sigma_max_eclipse", 3), "sigma_max_eclipse > 3"),
    "q_filter_peak_or_eclipse": (P.peak_or_eclipse(5), "sigma_max_peak >= 5 OR sigma_max_eclipse >= 5"),
    "q_filter_5sig": (P.five_sigma(), "b_peak_max > 13.2 OR b_eclipse_max > 12.38"),
    "q_filter_min_counts": (P.above("n_max", 5), "n_max > 5"),
    "q_filter_max_counts": (P.below("n_max", 30), "n_max < 30"),
    "q_filter_bccd_ratio": (P.below("bccd_ratio", 0.5), "bccd_ratio < 0.5"),
    "q_filter_length": (P.above("length", 100), "length > 100"),
    "q_filter_gti_bins": (P.bins_at_least(3, "peak", "gti", 2), "n_3_sig_peak_bins_gti >= 2"),
    "q_filter_separation": (P.separated("sep_arcsec", 20, "lower"), "sep_arcsec < 20"),
    "q_filter_not_variable": (P.not_variable(), "NOT var_flag"),
}
for _name, (_predicate, _sql) in PREDICATES.items():
    REGISTER[_name] = (lambda s, d, p=_predicate: P.apply(measured(s, d), p).select("region", "runid"), put(f"SELECT region, runid FROM m WHERE {_sql}", "regions", m=MEASURED))

CATEGORIES = [
    [P.time_bin(5), P.time_bin(50), P.time_bin(200)],
    [P.energy_range(0.2, 2.0), P.energy_range(2.0, 12.0), P.energy_range(0.2, 12.0)],
    [P.peak_or_eclipse(x) for x in (3, 4, 5, 6)],
    [P.above("length", x) for x in (50, 100, 150, 200)],
    [P.below("area_bbox", 12)],
    [P.not_variable()],
]
_CHOICES = [["true", *x] for x in (["contains(runid, '_5_')", "contains(runid, '_50_')", "contains(runid, '_200_')"], ["regexp_matches(runid, '0.2_2.0')", "regexp_matches(runid, '2.0_12.0')", "regexp_matches(runid, '0.2_12.0')"],
    [f"(sigma_max_peak >= {x} OR sigma_max_eclipse >= {x})" for x in (3, 4, 5, 6)], [f"length > {x}" for x in (50, 100, 150, 200)], ["area_bbox < 12"], ["NOT var_flag"])]
_NODE, _EACH = "0::BIGINT", ""
for _k, _c in enumerate(_CHOICES):
    _NODE = f"({_NODE} * {len(_c)} + c{_k})"
    _EACH += f", (SELECT unnest(range({len(_c)})) AS c{_k}) x{_k}"
_TEST = " AND ".join(f"CASE c{k} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(c)) + " END" for k, c in enumerate(_CHOICES))


@query(put(f"SELECT {_NODE} AS node, count(*) AS n_reg, count(DISTINCT cluster_label) AS n_unique FROM m{_EACH} WHERE {_TEST} GROUP BY ALL", "regions", m=MEASURED))
def q_subset_lattice(s, d):
    return P.lattice(measured(s, d), CATEGORIES)


@query(put("SELECT '5sig' AS filter, count(*) AS n_original, count(*) FILTER (b_peak_max > 13.2 OR b_eclipse_max > 12.38) AS n_filtered, count(*) FILTER (NOT (b_peak_max > 13.2 OR b_eclipse_max > 12.38)) AS n_removed FROM m", "regions", m=MEASURED))
def q_filter_info(s, d):
    return P.info(measured(s, d), P.five_sigma())


EXCLUDED = ("0000000011", "0000000102", "0000000203")
FLAGS = """SELECT *, contains(runid, '_5_') AND intensity < 500 AS low_counts, count(*) OVER (PARTITION BY runid) > 2 AS crowded_run, regexp_extract(runid, '(\\d{10})', 1) IN ('0000000011', '0000000102', '0000000203') AS excluded FROM m"""


def flagged(s, d):
    return P.quality_flags(measured(s, d), EXCLUDED, 2)


@query(put("SELECT region, low_counts, crowded_run, excluded FROM f", "regions", m=MEASURED, f=FLAGS))
def q_quality_flags(s, d):
    return flagged(s, d).select("region", "low_counts", "crowded_run", "excluded")


@query(put("""SELECT flag, count(*) FILTER (on_) AS n_all, count(*) FILTER (on_ AND s) AS n_strong, round(100.0::DOUBLE * count(*) FILTER (on_) / count(*), 6) AS pct_all, round(100.0::DOUBLE * count(*) FILTER (on_ AND s) / count(*) FILTER (s), 6) AS pct_strong
    FROM (SELECT b_peak_max > 13.2 AS s, unnest(['low_counts', 'crowded_run', 'excluded']) AS flag, unnest([low_counts, crowded_run, excluded]) AS on_ FROM f) GROUP BY flag""", "regions", m=MEASURED, f=FLAGS))
def q_flag_stats(s, d):
    out = P.flag_statistics(flagged(s, d), ("low_counts", "crowded_run", "excluded"), F.col("b_peak_max") > 13.2)
    return out.withColumn("pct_all", F.round("pct_all", 6)).withColumn("pct_strong", F.round("pct_strong", 6))


#: Rectangles of detector defects for the tests: time bin, corner and size.
RECTANGLES = [(5, 100.0, 100.0, 200.0, 150.0), (50, 400.0, 300.0, 120.0, 300.0), (200, 0.0, 500.0, 300.0, 200.0), (200, 600.0, 600.0, 100.0, 250.0)]
RECT = "SELECT rect_t_bin, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM (VALUES " + ", ".join(str(r) for r in RECTANGLES) + ") v(rect_t_bin, x, y, w, h)"
HOT = "SELECT m.*, rect_t_bin, x FROM m JOIN rect ON t_bin = rect_t_bin AND x_img > x AND x_img < x + w AND y_img > y AND y_img < y + h"


def rectangles(s):
    return s.createDataFrame(RECTANGLES, "rect_t_bin int, x double, y double, w double, h double")


@query(put(f"SELECT region, detid, detid IN (SELECT detid FROM ({HOT})) AS is_hot FROM m", "regions", m=MEASURED, rect=RECT))
def q_hot_rect_flag(s, d):
    return P.hot_flag(measured(s, d), rectangles(s)).select("region", "detid", "is_hot")


@query(put(f"SELECT rect_t_bin, x, count(*) AS n_regions, count(DISTINCT obsid) AS n_obsids FROM ({HOT}) GROUP BY ALL", "regions", m=MEASURED, rect=RECT))
def q_hot_rect_counts(s, d):
    return P.in_rectangles(measured(s, d), rectangles(s)).groupBy("rect_t_bin", F.col("x").cast("double").alias("x")).agg(F.count("*").alias("n_regions"), F.countDistinct("obsid").alias("n_obsids"))


@query(put("SELECT otype, n, round(100.0::DOUBLE * n / 5000, 6) AS pct FROM (SELECT p_type AS otype, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'NO MATCH', 5000 - (SELECT count(*) FROM part))"))
def q_otype_stats(s, d):
    return S.otype_counts(A.otypes(s, d), 5000)


OTYPES = ("ECONOMY", "STANDARD", "SMALL")


@query("SELECT p_brand AS subtype, " + ", ".join(f"CAST(coalesce(sum(p_size) FILTER (p_type = '{o}'), 0) AS BIGINT) AS \"{o}\"" for o in OTYPES) + " FROM part GROUP BY p_brand")
def q_otype_pivot(s, d):
    return S.otype_pivot(A.otypes(s, d), OTYPES)


@query(put("SELECT t_bin, segment, count(*) AS n, grouping(t_bin) * 2 + grouping(segment) AS margin FROM regions GROUP BY CUBE (t_bin, segment)", "regions"))
def q_contingency(s, d):
    return S.contingency(A.regions(s, d), "t_bin", "segment")


@query(put("SELECT b_peak_max > 13.2 AS is_peak, b_eclipse_max > 12.38 AS is_eclipse, count(*) AS n FROM m GROUP BY ALL", "regions", m=MEASURED))
def q_peak_eclipse_partition(s, d):
    return S.partition_counts(measured(s, d), F.col("b_peak_max") > 13.2, F.col("b_eclipse_max") > 12.38)


@query(put("SELECT threshold, count(*) FILTER (b_peak_max > threshold) AS n_over FROM m, (SELECT unnest([0.0, 2.5, 5.0, 7.5, 10.0, 12.5, 15.0, 20.0])::DOUBLE AS threshold) GROUP BY threshold", "regions", m=MEASURED))
def q_threshold_sweep(s, d):
    return S.threshold_sweep(measured(s, d), "b_peak_max", (0.0, 2.5, 5.0, 7.5, 10.0, 12.5, 15.0, 20.0))


@query(put("""SELECT segment AS otype, count(*) AS n, round(avg(sep_arcsec), 6) AS mean_sep, round(stddev_samp(sep_arcsec), 6) AS std_sep, round(quantile_cont(sep_arcsec, 0.16), 6) AS q16, round(quantile_cont(sep_arcsec, 0.84), 6) AS q84
    FROM m GROUP BY segment HAVING count(*) >= 10""", "regions", m=MEASURED))
def q_otype_separation(s, d):
    return S.by_type(measured(s, d).select(F.col("segment").alias("otype"), F.col("sep_arcsec").alias("sep")), 10)


@query(put("""SELECT sigma, kind, count(DISTINCT region) AS n_regions, count(DISTINCT obsid) AS n_obsids FROM (SELECT r.region, m.obsid, sigma, kind FROM (SELECT region, unnest(['3', '5']) AS sigma, unnest([b_peak_max > 5.9, b_peak_max > 13.2]) AS s, obsid FROM m) m
    JOIN (SELECT * FROM pairs WHERE sep <= 20) r USING (region) JOIN (SELECT cat_id, unnest(['Full', 'Variable']) AS kind, unnest([true, var_flag]) AS v FROM catalogue) c USING (cat_id) WHERE s AND v) GROUP BY ALL""", "pairs", m=MEASURED))
def q_extras_comparison(s, d):
    return K.external_comparison(measured(s, d), A.catalogue(s, d), 20.0, {"3": 5.9, "5": 13.2})


UNIQUE = "SELECT cluster_label, min(region) AS first_region, count(*) AS n_detections, round(avg(ra_deg), 9) AS ra_deg, round(avg(dec_deg), 9) AS dec_deg, round(avg(intensity), 6) AS mean_total_counts, round(avg(area_bbox), 6) AS mean_area FROM m GROUP BY cluster_label"


@query(put(UNIQUE, "regions", m=MEASURED))
def q_unique_catalogue(s, d):
    return K.unique_catalogue(measured(s, d)).drop("name")


@query(put("SELECT detid, obsid, t_bin, split_part(runid, '_', 4)::DOUBLE AS e_lo, split_part(runid, '_', 5)::DOUBLE AS e_hi, label, region, intensity, area_bbox, ra_deg, dec_deg, cluster_label FROM m", "regions", m=MEASURED))
def q_detection_catalogue(s, d):
    return K.detection_catalogue(measured(s, d)).drop("name")


@query(put("""SELECT u.cluster_label, CASE WHEN s.sep <= 20 THEN s.cat_id END AS cat_id, CASE WHEN s.sep <= 20 THEN s.sep END AS sep_arcsec, coalesce(s.sep <= 20, false) AS has_match
    FROM (SELECT DISTINCT cluster_label FROM m) u LEFT JOIN (SELECT * FROM (SELECT m.cluster_label, cat_id, sep, row_number() OVER (PARTITION BY m.cluster_label ORDER BY sep, cat_id) AS r FROM pairs JOIN m USING (region) WHERE sep <= 60) WHERE r = 1) s USING (cluster_label)""", "pairs", m=MEASURED))
def q_matched_unique(s, d):
    r = measured(s, d)
    pairs = C.within(r, A.catalogue(s, d), 60.0).join(r.select("region", "cluster_label").hint("merge"), "region")
    return K.masked_matches(r.select("cluster_label").distinct(), pairs, 20.0)


@query(put("SELECT obsid, min(runid) AS first_run, count(*) AS n_regions, count(DISTINCT runid) AS n_runs, max(intensity) AS max_intensity FROM regions GROUP BY obsid", "regions"))
def q_observation_info(s, d):
    return K.observation_info(A.regions(s, d))


@query(put("SELECT region, runid, label, cluster_label, intensity FROM m WHERE cluster_label = 7", "regions", m=MEASURED))
def q_region_summary(s, d):
    return K.region_summary(measured(s, d), 7)["detections"]


@query(put("SELECT segment, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM regions), 6) AS pct FROM regions GROUP BY segment", "regions"))
def q_value_counts(s, d):
    r = A.regions(s, d)
    n = r.groupBy("segment").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(r.agg(F.count("*").alias("total")))).select("segment", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


@query(put("(SELECT obsid FROM regions WHERE t_bin = 5 INTERSECT SELECT obsid FROM regions WHERE t_bin = 50) EXCEPT SELECT obsid FROM regions WHERE label = 0 AND t_bin = 200", "regions"))
def q_set_operations(s, d):
    r = A.regions(s, d)
    both = r.where("t_bin = 5").select("obsid").intersect(r.where("t_bin = 50").select("obsid"))
    return both.exceptAll(r.where("label = 0 and t_bin = 200").select("obsid").intersect(both))


@query(put("""SELECT t_bin, round(avg(x), 6) AS mean_x, round(quantile_cont(x, 0.16), 6) AS q16, round(quantile_cont(x, 0.84), 6) AS q84 FROM (SELECT t_bin, runid, count(*) / t_bin::DOUBLE AS x FROM regions GROUP BY t_bin, runid) GROUP BY t_bin""", "regions"))
def q_events_per_frame(s, d):
    per = A.regions(s, d).groupBy("t_bin", "runid").agg((F.count("*") / F.col("t_bin")).alias("x"))
    return per.groupBy("t_bin").agg(F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.percentile("x", F.lit(0.16)), 6).alias("q16"), F.round(F.percentile("x", F.lit(0.84)), 6).alias("q84"))


@query(put("SELECT count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_events, count(DISTINCT obsid || '_' || it) AS n_frames, round(count(*) / count(DISTINCT obsid || '_' || it)::DOUBLE, 6) AS cells_per_frame FROM cells", "cells"))
def q_cell_totals(s, d):
    frames = F.countDistinct("obsid", "it")
    return cells_of(s, d).agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_events"), frames.alias("n_frames"), F.round(F.count("*") / frames, 6).alias("cells_per_frame"))


@query(put("SELECT detid, split_part(detid, '_', 1) AS obsid, CAST(split_part(detid, '_', 3) AS INTEGER) AS t_bin, split_part(detid, '_', 6) AS label, regexp_extract(detid, '(\\d{10})', 1) AS obs FROM regions", "regions"))
def q_identifiers(s, d):
    return K.parsed_identifiers(A.regions(s, d).select("detid"))


@query(put("SELECT runid, key, CAST(value AS VARCHAR) AS value FROM (SELECT runid, unnest(['n', 'lo', 'hi']) AS key, unnest([count(*), min(intensity), max(intensity)]) AS value FROM regions GROUP BY runid)", "regions"))
def q_info_rows(s, d):
    info = A.regions(s, d).groupBy("runid").agg(F.count("*").alias("n"), F.min("intensity").alias("lo"), F.max("intensity").alias("hi"))
    return K.as_rows(info, "runid")


@query("SELECT vec_id % 5 AS g, count(*) AS n, count(DISTINCT label) AS labels FROM embeddings GROUP BY ALL")
def q_vector_groups(s, d):
    return A.table(s, d, "embeddings").groupBy((F.col("vec_id") % 5).alias("g")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


ROUNDS = 6


def lloyd_parts(ks: str) -> dict[str, str]:
    """Lloyd's rounds in SQL over ``raw`` (id, d, v), from the first vectors by id."""
    vectors = "SELECT id, r.d, (v - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS x FROM raw r JOIN (SELECT d, avg(v) AS m, stddev_samp(v) AS s FROM raw GROUP BY d) USING (d)"
    out = {"v": vectors, "ranked": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM (SELECT DISTINCT id FROM raw)", "c0": f"SELECT k, r AS c, d, x FROM (SELECT unnest({ks}) AS k) JOIN ranked ON r < k JOIN v USING (id)"}
    for t in range(ROUNDS + 1):
        out[f"a{t}"] = f"SELECT k, id, (min({{'d': d2, 'c': c}})).c AS c, min(d2) AS d2 FROM (SELECT c.k, v.id, c.c, sum(pow(v.x - c.x, 2)) AS d2 FROM v JOIN c{t} c USING (d) GROUP BY ALL) GROUP BY ALL"
        if t < ROUNDS:
            out[f"c{t + 1}"] = f"SELECT k, c, d, avg(x) AS x FROM a{t} JOIN v USING (id) GROUP BY ALL UNION ALL SELECT k, c, d, x FROM c{t} c WHERE NOT EXISTS (SELECT 1 FROM a{t} a WHERE a.k = c.k AND a.c = c.c)"
    return out


@query(put(f"""SELECT k, round(sum(d2), 4) AS inertia, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
    SELECT k, id, any_value(d2) AS d2, max(CASE WHEN own THEN n END) AS n, max(CASE WHEN own THEN d * n / (n - 1) END) AS a, min(CASE WHEN NOT own THEN d END) AS b FROM (
      SELECT a.k, a.id, a.d2, s.c = a.c AS own, s.n::DOUBLE AS n, p.q + s.q - 2 * sum(v.x * m.x) AS d FROM a{ROUNDS} a JOIN sizes s ON s.k = a.k JOIN v ON v.id = a.id JOIN mids m ON m.k = s.k AND m.c = s.c AND m.d = v.d JOIN squares p ON p.id = a.id GROUP BY a.k, a.id, a.d2, a.c, s.c, s.n, s.q, p.q) GROUP BY k, id) GROUP BY k""",
    raw="SELECT vec_id AS id, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings", **lloyd_parts("range(2, 20)"),
    squares="SELECT id, sum(x * x) AS q FROM v GROUP BY id", sizes=f"SELECT k, c, count(*) AS n, avg(q) AS q FROM a{ROUNDS} JOIN squares USING (id) GROUP BY ALL", mids=f"SELECT k, c, d, avg(x) AS x FROM a{ROUNDS} JOIN v USING (id) GROUP BY ALL"))
def q_kmeans(s, d):
    out = learning.kmeans_sweep(A.table(s, d, "embeddings").select("vec_id", "embedding"), range(2, 20), rounds=ROUNDS)
    return out.select("k", F.round("inertia", 4).alias("inertia"), F.round("silhouette", 6).alias("silhouette"))


@query(put(f"SELECT id.runid AS runid, id.label AS label, c AS cluster FROM a{ROUNDS}", "curves",
    raw="SELECT {'runid': runid, 'label': label} AS id, d, coalesce(any_value(p.v), 0) AS v FROM (SELECT DISTINCT runid, label, unnest(range(32)) AS d FROM curves) LEFT JOIN (SELECT runid, label, CAST(least(floor((it - lo) * 32 / w), 31) AS BIGINT) AS d, sum(n)::DOUBLE AS v FROM curves JOIN (SELECT runid, label, min(it) AS lo, max(it) - min(it) + 1 AS w FROM curves GROUP BY ALL) USING (runid, label) GROUP BY ALL) p USING (runid, label, d) GROUP BY runid, label, d",
    **lloyd_parts("[3]")))
def q_series_kmeans(s, d):
    from .curve_queries import curves_of

    return learning.series_clusters(curves_of(s, d), 3, rounds=ROUNDS)


@query()
def q_injection(s, d):
    """Bursts put on what each observation has in an occupied pixel and frame; random draws have no SQL."""
    from .cube_queries import cells_of

    rates = cells_of(s, d).groupBy("obsid").agg((F.sum("n") / (F.countDistinct("ix", "iy") * F.countDistinct("it"))).alias("background"))
    return simulation.recovery_over(rates, amplitudes=(5, 20, 80), draws=20)


@query(put("""SELECT obsid, ix, iy, share, min(k) AS n FROM (SELECT obsid, ix, iy, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY obsid, ix, iy ORDER BY k) AS cdf
    FROM (SELECT obsid, ix, iy, round(mean_n, 6) AS mean FROM image WHERE mean_n > 0), (SELECT unnest(range(400)) AS k)), (SELECT unnest([0.0013, 0.1587, 0.5, 0.8413, 0.9987]::DOUBLE[]) AS share) WHERE cdf >= share GROUP BY ALL""", "image"))
def q_poisson_envelope(s, d):
    """Quantiles of the counts that every pixel's mean would give."""
    from ..operators import cube
    from .cube_queries import cells_of

    means = cube.images(cells_of(s, d)).select("obsid", "ix", "iy", F.round("mean_n", 6).alias("mean"))
    return means.join(simulation.envelope(means), "mean").select("obsid", "ix", "iy", "share", "n")


@query("SELECT obsid, t_bin, e_lo, e_hi FROM (SELECT DISTINCT lpad(CAST(user_id % 3 AS VARCHAR), 10, '0') AS obsid FROM events), (SELECT unnest([300, 600, 1000]) AS t_bin), (SELECT unnest([0.2, 2.0, 0.2])::DOUBLE AS e_lo, unnest([2.0, 12.0, 12.0])::DOUBLE AS e_hi)")
def q_parameter_grid(s, d):
    from .pipeline import parameter_grid

    return parameter_grid(A.photons(s, d).select("obsid").distinct())


@query(put("""SELECT obsid, t_bin, e_lo, e_hi, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS max_n FROM (SELECT obsid, t_bin, e_lo, e_hi, ix, iy, t_us // (t_bin::BIGINT * 72000000) AS it, count(*) AS n FROM photons,
    (SELECT unnest([300, 600, 1000]) AS t_bin), (SELECT unnest([0.2, 2.0, 0.2])::DOUBLE AS e_lo, unnest([2.0, 12.0, 12.0])::DOUBLE AS e_hi) WHERE pi > e_lo * 1000 AND pi < e_hi * 1000 GROUP BY ALL) GROUP BY ALL""", "photons"))
def q_pipeline_runs(s, d):
    from .pipeline import run_summaries

    return run_summaries(A.photons(s, d), frame_scale_us=72_000_000)


@query("SELECT user_id AS pixel, epoch_us(ts) // 21600000000 AS frame, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def q_stream_counts(s, d):
    s.conf.set("spark.sql.session.timeZone", "UTC")
    out = live.drained(live.counts(live.event_stream(s, d)), store.scratch(s, "counts"), "complete")
    return out.select("pixel", F.expr("unix_micros(w.start) div 21600000000").alias("frame"), "n", F.round("total", 6).alias("total"))


@query("""SELECT pixel, min(t) AS start_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY pixel ORDER BY t) AS g FROM (SELECT user_id AS pixel, epoch_us(ts) AS t,
    CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY pixel, g""")
def q_event_sessions(s, d):
    s.conf.set("spark.sql.session.timeZone", "UTC")
    e = A.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("pixel"))
    return live.sessions(e).select("pixel", F.unix_micros(F.col("w.start")).alias("start_us"), "n")


def results(s, d):
    r = measured(s, d)
    return Results(flagged(s, d), C.within(r, A.catalogue(s, d), 20.0))


@query(put("SELECT count(*) AS n_regions, count(DISTINCT cluster_label) AS n_unique, count(DISTINCT obsid) AS n_obs, count(DISTINCT runid) AS n_runs, max(intensity) AS max_intensity FROM m", "regions", m=MEASURED))
def q_homepage(s, d):
    return results(s, d).homepage()


@query(put("SELECT cluster_label, count(*) AS n_detections, max(intensity) AS max_intensity FROM m WHERE segment = 'MACHINERY' GROUP BY cluster_label", "regions", m=MEASURED))
def q_object_type(s, d):
    return results(s, d).object_type("MACHINERY")


@query(put("SELECT region, 'low_counts' AS flag FROM f WHERE low_counts UNION ALL SELECT region, 'crowded_run' FROM f WHERE crowded_run UNION ALL SELECT region, 'excluded' FROM f WHERE excluded", "regions", m=MEASURED, f=FLAGS))
def q_raised_flags(s, d):
    return results(s, d).flags(["low_counts", "crowded_run", "excluded"])


@query(put("SELECT c.cluster_label, p.cluster_label AS previous, n.cluster_label AS next FROM u c LEFT JOIN u p ON p.cluster_label = c.cluster_label - 1 LEFT JOIN u n ON n.cluster_label = c.cluster_label + 1", "regions", m=MEASURED, u="SELECT DISTINCT cluster_label FROM m"))
def q_paging(s, d):
    return results(s, d).neighbours()


@query(put("SELECT r.region, p.cat_id, p.sep FROM m r JOIN pairs p USING (region) WHERE r.cluster_label = 10 AND p.sep <= 20.0", "pairs", m=MEASURED))
def q_region_matches(s, d):
    return results(s, d).region(10)["matches"].select("region", "cat_id", "sep")


@query(put("SELECT obsid, start, stop FROM bti", "bti"))
def q_stream_bad_times(s, d):
    """Bad times of a stream of events that come in no order, several files at a time."""
    from ..operators.cube import FRAME_US

    root = store.scratch(s, "live")
    events = A.photons(s, d).select("obsid", F.timestamp_micros(F.col("t_us")).alias("ts"), "t_us", "pi")
    events.repartition(4, F.xxhash64("t_us")).write.parquet(f"{root}/in")
    # an observation that is long over when the others have ended, so that the watermark passes them
    end = events.agg(F.lit("after").alias("obsid"), (F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), (F.max("t_us") + 8_640_000_000_000).alias("t_us"), F.lit(0).alias("pi"))
    end.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    found = live.drained(live.bad_times_of_events(stream, FRAME_US, 0.0, "40 days"), f"{root}/out", "append")
    return found.where("obsid <> 'after'")
