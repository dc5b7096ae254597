"""Queries on sources of a run, its checks, stored results and the remaining features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bayes
from ..functions import geometry as G
from ..operators import background, cleaning
from ..operators import catalogues as K
from ..operators import crossmatch as C
from ..operators import filters as P
from ..operators import features as X
from ..operators import regions as R
from ..operators import statistics as S
from ..sources import adapters as A
from ..sources import fits, store
from .catalogue_queries import EXCLUDED, HOT, MEASURED, RECT, measured, rectangles
from .cube_queries import CCD_FRAMES, COMPONENTS, REACH, SIGMA_ENDS, cells_of, labelled_of, template_parts
from .curve_queries import KS, curves_of
from .oracle import FRAME, PARTS, factor, put
from .pipeline import TransientPipeline

REGISTER: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTER[f.__name__] = (f, sql)
        return f

    return add


SOURCE_LISTS = """SELECT s_suppkey AS source, lpad(CAST(s_suppkey % 3 AS VARCHAR), 10, '0') AS obsid, (s_suppkey % 20)::DOUBLE AS det_ml, CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey % 7) * 4.0 ELSE 0 END::DOUBLE AS extent,
    abs(s_acctbal)::DOUBLE / 4000 AS total_rate, 150.0::DOUBLE + ((s_suppkey * 37) % 100 - 50) * 0.004::DOUBLE AS ra_deg, 20.0::DOUBLE + ((s_suppkey * 53) % 100 - 50) * 0.004::DOUBLE AS dec_deg FROM supplier"""
KNOWN = """SELECT *, CASE WHEN extent = 0 THEN 'point' ELSE 'extended' END AS kind, CASE WHEN extent > 0 THEN extent WHEN total_rate > 1 THEN 80.0 WHEN total_rate > 0.1 THEN 40.0 ELSE 20.0 END::DOUBLE AS radius FROM lists WHERE det_ml > 8"""


@query(put("SELECT source, obsid, kind, round(radius, 6) AS radius FROM known", lists=SOURCE_LISTS, known=KNOWN))
def q_known_sources(s, d):
    return background.known_sources(A.source_lists(s, d)).select("source", "obsid", "kind", F.round("radius", 6).alias("radius"))


WCS = """SELECT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS obsid, n_nationkey * 0.01::DOUBLE + 150.0::DOUBLE AS crval_x, 20.0::DOUBLE - n_nationkey * 0.01::DOUBLE AS crval_y, 25921.0::DOUBLE / 80 AS crpix, 1.388888888888889e-05::DOUBLE * 80 AS cdelt FROM nation WHERE n_nationkey < 3"""
PROJECTED = """SELECT source, k.obsid, degrees(cos(d) * sin(dr) / den) / -cdelt + crpix - 1 AS px, degrees((sin(d) * cos(d0) - cos(d) * sin(d0) * cos(dr)) / den) / cdelt + crpix - 1 AS py FROM (
    SELECT *, sin(d) * sin(d0) + cos(d) * cos(d0) * cos(dr) AS den FROM (SELECT l.*, w.crpix, w.cdelt, radians(dec_deg) AS d, radians(crval_y) AS d0, radians(ra_deg - crval_x) AS dr FROM lists l JOIN wcs w USING (obsid))) k"""


def wcs_of(s, d):
    h = A.headers(s, d)
    return h.select("obsid", *[c.alias(n) for n, c in G.wcs(F.col("header")).items()])


@query(put("SELECT obsid, round(crval_x, 9) AS crval_x, round(crpix, 9) AS crpix_x, round(-cdelt, 12) AS cdelt_x, 648.0::DOUBLE AS naxis_x, round(crval_y, 9) AS crval_y FROM wcs", wcs=WCS))
def q_wcs(s, d):
    w = wcs_of(s, d)
    return w.select("obsid", F.round("crval_x", 9).alias("crval_x"), F.round("crpix_x", 9).alias("crpix_x"), F.round("cdelt_x", 12).alias("cdelt_x"), "naxis_x", F.round("crval_y", 9).alias("crval_y"))


@query(put("SELECT source, obsid, round(px, 5) AS px, round(py, 5) AS py FROM projected", lists=SOURCE_LISTS, wcs=WCS, projected=PROJECTED))
def q_sky_to_pixel(s, d):
    joined = A.source_lists(s, d).join(wcs_of(s, d), "obsid")
    px, py = G.sky_to_pixel(F.col("ra_deg"), F.col("dec_deg"), (F.col("crpix_x"), F.col("crpix_y")), (F.col("cdelt_x"), F.col("cdelt_y")), (F.col("crval_x"), F.col("crval_y")))
    return joined.select("source", "obsid", F.round(px, 5).alias("px"), F.round(py, 5).alias("py"))


@query(put("""SELECT source, obsid, round(px * 80, 4) AS x_sky, round(py * 80, 4) AS y_sky, round((px * 80 - 20000) / 12000 * 30, 6) AS x_cube, round((py * 80 - 20000) / 12000 * 30, 6) AS y_cube FROM projected
    WHERE px * 80 > 20000 AND px * 80 < 32000 AND py * 80 > 20000 AND py * 80 < 32000""", lists=SOURCE_LISTS, wcs=WCS, projected=PROJECTED))
def q_sources_on_cube(s, d):
    edges = (20000.0, 32000.0, 31)
    placed = background.on_cube(A.source_lists(s, d), wcs_of(s, d), edges, edges)
    return placed.select("source", "obsid", *[F.round(c, n).alias(c) for c, n in (("x_sky", 4), ("y_sky", 4), ("x_cube", 6), ("y_cube", 6))])


@query(put("SELECT region, round(dec_deg + 0.01::DOUBLE * 0, 6) AS dec_deg, round(dec2, 6) AS dec2, round(sep, 4) AS sep FROM (SELECT *, degrees(asin(sin(radians(dec_deg)) * cos(radians(0.5)) + cos(radians(dec_deg)) * sin(radians(0.5)) * cos(radians(30.0)))) AS dec2, 1800.0::DOUBLE AS sep FROM regions)", "regions"))
def q_offset_by(s, d):
    ra, dec = G.offset_by(F.col("ra_deg"), F.col("dec_deg"), 30.0, F.lit(0.5))
    moved = A.regions(s, d).withColumn("ra2", ra).withColumn("dec2", dec)
    sep = G.separation(F.col("ra_deg"), F.col("dec_deg"), F.col("ra2"), F.col("dec2"))
    return moved.select("region", F.round("dec_deg", 6).alias("dec_deg"), F.round("dec2", 6).alias("dec2"), F.round(sep, 4).alias("sep"))


@query(put("""SELECT region, round((122.93192::DOUBLE - degrees(atan2(cos(d) * sin(r), sin(d) * cos(p) - cos(d) * sin(p) * cos(r))) + 720) % 360, 6) AS l, round(degrees(asin(sin(d) * sin(p) + cos(d) * cos(p) * cos(r))), 6) AS b
    FROM (SELECT region, radians(ra_deg - 192.85948::DOUBLE) AS r, radians(dec_deg) AS d, radians(27.12825::DOUBLE) AS p FROM regions)""", "regions"))
def q_galactic(s, d):
    lon, lat = G.to_galactic(F.col("ra_deg"), F.col("dec_deg"))
    return A.regions(s, d).select("region", F.round(lon, 6).alias("l"), F.round(lat, 6).alias("b"))


@query(put("""SELECT region, angle, round(25719.0 + (x_img - 25719.0) * cos(radians(-angle)) - (y_img - 25719.0) * sin(radians(-angle)), 5) AS x_det, round(25719.0 + (x_img - 25719.0) * sin(radians(-angle)) + (y_img - 25719.0) * cos(radians(-angle)), 5) AS y_det
    FROM regions JOIN (SELECT lpad(CAST(n_nationkey * 10 AS VARCHAR), 10, '0') AS obsid, n_nationkey * 14.5::DOUBLE AS angle FROM nation WHERE n_nationkey % 4 <> 3) USING (obsid)""", "regions"))
def q_detector_frame_lookup(s, d):
    joined = A.regions(s, d).join(A.pointings(s, d), "obsid")  # an observation without an angle has no detector frame
    x, y = G.rotate(F.col("x_img"), F.col("y_img"), F.col("angle"))
    return joined.select("region", "angle", F.round(x, 5).alias("x_det"), F.round(y, 5).alias("y_det"))


@query(put("SELECT region, obsid, area_bbox FROM regions WHERE area_bbox <= 12", "regions"))
def q_small_regions(s, d):
    return K.small_regions(A.regions(s, d), 12).select("region", "obsid", "area_bbox")


@query(put("""SELECT p.obsid, p.label, p.area_bbox FROM (SELECT obsid, label, (max(ix) + 1 - min(ix)) * (max(iy) + 1 - min(iy)) AS area_bbox FROM parts GROUP BY obsid, label) p WHERE area_bbox <= 36""", "flagged", reach=REACH, parts=COMPONENTS))
def q_small_detections(s, d):
    return K.small_regions(R.properties(labelled_of(s, d))).select("obsid", "label", "area_bbox")


RATIOS = "SELECT region, CASE WHEN region % 7 = 0 THEN 'Infinity'::DOUBLE WHEN region % 7 = 1 THEN '-Infinity'::DOUBLE WHEN region % 7 = 2 THEN 'NaN'::DOUBLE WHEN region % 7 = 3 THEN NULL ELSE intensity / 8.0::DOUBLE END AS ratio FROM regions"


def ratios_of(s, d):
    r, k = A.regions(s, d), F.col("region") % 7
    odd = F.when(k == 0, float("inf")).when(k == 1, float("-inf")).when(k == 2, float("nan")).when(k == 3, None).otherwise(F.col("intensity") / 8)
    return r.select("region", odd.alias("ratio"))


@query(put("SELECT region, CASE WHEN isfinite(ratio) THEN ratio END AS ratio FROM ratios", "regions", ratios=RATIOS))
def q_scrubbed(s, d):
    return S.scrubbed(ratios_of(s, d), ["ratio"])


@query(put("SELECT region, ratio FROM ratios WHERE isfinite(ratio)", "regions", ratios=RATIOS))
def q_scrubbed_rows(s, d):
    return S.scrubbed(ratios_of(s, d), ["ratio"], drop=True)


@query(put("SELECT region, runid AS run, CAST(label AS VARCHAR) AS label FROM regions", "regions"))
def q_tuple_keys(s, d):
    key = F.concat(F.lit("('"), "runid", F.lit("', '"), F.col("label").cast("string"), F.lit("')"))
    keyed = A.regions(s, d).select("region", key.alias("key"))
    return K.tuple_keys(keyed, "key").select("region", F.col("runid").alias("run"), "label")


@query(put("SELECT region, intensity FROM (SELECT *, row_number() OVER (ORDER BY intensity, region) - 1 AS r FROM regions) WHERE r >= 10 AND r < 60", "regions"))
def q_row_range(s, d):
    return S.row_range(A.regions(s, d).select("region", "intensity"), ["intensity", "region"], 10, 60)


@query(put("SELECT obsid, count(*) AS n FROM regions GROUP BY obsid HAVING count(*) > 1", "regions"))
def q_frequent(s, d):
    return S.frequent(A.regions(s, d), "obsid", 1)


@query(put(f"SELECT obsid, ix, iy, it, round(n / {FRAME / 1e6}::DOUBLE, 12) AS rate FROM cells", "cells"))
def q_rates(s, d):
    return cells_of(s, d).select("obsid", "ix", "iy", "it", F.round(F.col("n") / (FRAME / 1e6), 12).alias("rate"))


@query(put("""SELECT 'regions' AS name, count(*) AS n_rows, 2 AS n_columns, true AS consistent FROM regions UNION ALL SELECT 'features', count(DISTINCT region), 2, count(DISTINCT region) = count(*) FROM regions
    UNION ALL SELECT 'unique', count(DISTINCT region // 2), 1, true FROM regions UNION ALL SELECT 'matched', count(DISTINCT region), 1, count(DISTINCT region) = count(DISTINCT region // 2) FROM regions""", "regions"))
def q_result_shapes(s, d):
    r = A.regions(s, d)
    tables = {"regions": r.select("region", "obsid"), "features": r.groupBy("region").agg(F.count("*").alias("n")), "unique": r.select(F.expr("region div 2").alias("u")).distinct(), "matched": r.select("region").distinct()}
    return S.shapes(tables, [("regions", "features"), ("unique", "matched")])


@query(put("SELECT k.k, k.n_peak, k.n_eclipse, count(*) AS n_cells FROM mu c ASOF JOIN knots k ON c.mu >= k.mu GROUP BY ALL", "mu", "knots"))
def q_limits_stored(s, d):
    """The stored limit table's rows that cells meet, and how many do."""
    root = store.scratch(s, "store")
    store.limits(s, root, 3)  # made
    held = bayes.knot_below(background.expectation(cells_of(s, d)), store.limits(s, root, 3))  # read again
    return held.groupBy("k", "n_peak", "n_eclipse").agg(F.count("*").alias("n_cells"))


@query(put("SELECT runid, label, it, n FROM curves WHERE runid = '0000000001' AND label = 300", "curves"))
def q_stored_light_curve(s, d):
    root, target = store.scratch(s, "runs"), store.scratch(s, "all")
    c = curves_of(s, d).select("runid", "label", "it", "n")
    for run in ("0000000000", "0000000001"):
        store.save(c.where(F.col("runid") == run), root, "light_curves", run)
    store.combine(s, root, target, ("light_curves", "regions"))
    return store.light_curve(s, target, "0000000001", 300).select("runid", "label", "it", "n")


@query(put("SELECT region, runid, intensity, ra_deg FROM regions", "regions"))
def q_stored_catalogue(s, d):
    path = f"{store.scratch(s, 'catalogue')}/detections"
    store.save_catalogue(A.regions(s, d).select("region", "runid", "intensity", "ra_deg"), path)
    return s.read.parquet(path)


@query(put("SELECT runid, CAST(count(*) AS VARCHAR) AS n, CAST(max(intensity) AS VARCHAR) AS top FROM regions GROUP BY runid", "regions"))
def q_stored_info(s, d):
    root = store.scratch(s, "info")
    info = A.regions(s, d).groupBy("runid").agg(F.count("*").alias("n"), F.max("intensity").alias("top"))
    store.save_info(info, root, "run_info")
    return store.load_info(s, root, "run_info", ["n", "top"])


@query("SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS obsid FROM orders")
def q_observation_ids(s, d):
    path = f"{store.scratch(s, 'ids')}/list"
    A.observations(s, d).select(F.concat(F.lit("  "), "obsid", F.lit(" "))).distinct().write.text(path)
    return store.observation_ids(s, path)


@query(put("SELECT evt_file, submode FROM lists WHERE instrument <> 'EPN' AND submode IN ('PrimeLargeWindow', 'PrimeFullWindowExtended', 'FastTiming')", "lists"))
def q_unknown_submodes(s, d):
    return cleaning.unknown_submodes(A.event_lists(s, d)).select("evt_file", "submode")


@query(put("SELECT evt_file FROM lists WHERE submode <> 'FastTiming'", "lists"))
def q_timing_guard(s, d):
    named = A.event_lists(s, d).withColumn("evt_file", F.when(F.col("submode") == "FastTiming", F.concat("evt_file", F.lit("TI"))).otherwise(F.col("evt_file")))
    return cleaning.refuse_timing(named.where("submode <> 'FastTiming'")).select("evt_file")


@query(put("SELECT event_id FROM photons WHERE x > 400 AND x < 2000 AND y > 0 AND y < 4000 AND t_us > 86400000000 AND t_us < 864000000000", "photons"))
def q_in_box(s, d):
    return A.photons(s, d).where(cleaning.in_box((400, 2000), (0, 4000), (86_400_000_000, 864_000_000_000))).select("event_id")


@query(put("SELECT event_id, rawx, rawy FROM photons WHERE instrument <> 'EPN' OR (rawy < 197 AND rawx > 4 AND rawx < 61)", "photons"))
def q_border_trim_large(s, d):
    return A.photons(s, d).where(cleaning.inside_borders("PrimeLargeWindow")).select("event_id", "rawx", "rawy")


@query(put("""SELECT obsid, ix, iy, it, coalesce(ur > 0 AND ub - ur < 0.25, false) AS spurious_peak, coalesce(n_rest < rest AND ub - ur < 0.25, false) AS spurious_eclipse FROM (
    SELECT *, (n_box - box) / nullif(box, 0) AS ub, (n_rest - rest) / nullif(rest, 0) AS ur FROM (SELECT c.obsid, c.ix, c.iy, c.it, b.n_box, f.n_frame - b.n_box AS n_rest, (b.box_around - b.n_box) / 10.0::DOUBLE AS box, ((f.n_around - b.box_around) - (f.n_frame - b.n_box)) / 10.0::DOUBLE AS rest FROM cells c JOIN (
      SELECT *, sum(n_box) OVER (PARTITION BY obsid, ix, iy ORDER BY it RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS box_around FROM (
        SELECT obsid, ix + dx AS ix, iy + dy AS iy, it, sum(n) AS n_box FROM cells, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) GROUP BY ALL)) b USING (obsid, ix, iy, it)
    JOIN (SELECT *, sum(n_frame) OVER (PARTITION BY obsid ORDER BY it RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n_around FROM (SELECT obsid, it, sum(n) AS n_frame FROM cells GROUP BY ALL)) f USING (obsid, it)))""", "cells"))
def q_spurious(s, d):
    return X.spurious(X.near_box(cells_of(s, d))).select("obsid", "ix", "iy", "it", "spurious_peak", "spurious_eclipse")


@query(put("""SELECT runid, label, CAST(len AS BIGINT) AS len, round(ks, 9) AS ks, round(CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda j: pow(-1, j - 1) * exp(-2 * j * j * lam * lam))))) END::DOUBLE, 6) AS p FROM (
    SELECT *, ks * sqrt(len::DOUBLE) AS lam FROM (SELECT runid, label, len, max(greatest(k / len - cdf, cdf - (k - c) / len)) AS ks FROM (
      SELECT *, list_sum(list_transform(range(0, v + 1), lambda j: exp(CASE WHEN j > 0 THEN j * ln(m) ELSE 0 END - m - lgamma(j + 1)))) AS cdf, (sum(c) OVER (PARTITION BY runid, label ORDER BY v))::DOUBLE AS k FROM (
        SELECT runid, label, n AS v, count(*) AS c FROM curves GROUP BY ALL) JOIN (SELECT runid, label, avg(n) AS m, count(*)::DOUBLE AS len FROM curves GROUP BY ALL) USING (runid, label)) GROUP BY ALL))""", "curves"))
def q_ks_poisson(s, d):
    out = X.ks_poisson(curves_of(s, d))
    return out.select("runid", "label", "len", F.round("ks", 9).alias("ks"), F.round("p", 6).alias("p"))


@query(put("""SELECT runid, label, m, round(least(1, greatest(0, 1 - 2 * area)), 6) AS p FROM (SELECT *, abs(t) / 2000 / 3 * c * list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(abs(t) * k / 2000.0::DOUBLE, 2) / v, -(v + 1) / 2))) AS area FROM (
    SELECT runid, label, m, a / (s / sqrt(m)) AS t, (m - 1)::DOUBLE AS v, exp(lgamma(m / 2.0::DOUBLE) - lgamma((m - 1) / 2.0::DOUBLE)) / sqrt((m - 1) * pi()) AS c FROM (SELECT runid, label, count(*) AS m, avg(mu - n) AS a, stddev_samp(mu - n) AS s FROM (
      SELECT *, it - min(it) OVER (PARTITION BY runid, label) AS t0 FROM curves) WHERE t0 < 60 GROUP BY ALL) WHERE s > 0))""", "curves"))
def q_paired_t_probability(s, d):
    t = X.paired_t(curves_of(s, d), 60)
    return t.select("runid", "label", "m", F.round(X.t_probability(F.col("t"), F.col("m") - 1), 6).alias("p"))


CURVE_SQL = ", ".join(f"((m.region * {k + 3}) % {40 + k}) / {k + 2}.0::DOUBLE AS lc_{c}" for k, c in enumerate(K.CURVE_COLUMNS))
NAME_SQL = """'J' || lpad(CAST(t // 36000 AS VARCHAR), 2, '0') || lpad(CAST(t // 600 % 60 AS VARCHAR), 2, '0') || lpad(CAST(t // 10 % 60 AS VARCHAR), 2, '0') || '.' || (t % 10) || CASE WHEN dec < 0 THEN '-' ELSE '+' END
    || lpad(CAST(a // 3600 AS VARCHAR), 2, '0') || lpad(CAST(a // 60 % 60 AS VARCHAR), 2, '0') || lpad(CAST(a % 60 AS VARCHAR), 2, '0')"""
NAMED = f"""SELECT cluster_label, ra, dec, n, {NAME_SQL} AS srcid FROM (SELECT *, CAST(floor(round(ra / 15 * 36000, 4)) AS BIGINT) AS t, CAST(floor(round(abs(dec) * 3600, 4)) AS BIGINT) AS a FROM (
    SELECT cluster_label, avg(ra_deg) AS ra, avg(dec_deg) AS dec, count(*) AS n FROM m GROUP BY cluster_label))"""
#: detid is not unique among the test regions, region is: it is added to it.
KEYED = "SELECT * EXCLUDE detid, detid || '_' || region AS detid FROM m0"


def keyed(s, d):
    return measured(s, d).withColumn("detid", F.concat_ws("_", "detid", F.col("region").cast("string")))


@query(put(f"""SELECT m.detid, n.srcid, m.cluster_label AS unique_reg_id, round(m.ra_deg, 6) AS ra_deg, round(m.dec_deg, 6) AS dec_deg, m.x_img AS "X", m.y_img AS "Y", m.area_bbox, round(m.intensity_mean / m.area_bbox, 9) AS mean_pixel_intensity, {CURVE_SQL},
    contains(runid, '_5_') AND intensity < 500 AS filt_tbin_5_n_l_5, regexp_extract(runid, '([0-9]{{10}})', 1) IN ('0000000011', '0000000102', '0000000203') AS filt_exclude_obsid, b_peak_max > 13.2 OR b_eclipse_max > 12.38 AS filt_5sig,
    count(*) OVER (PARTITION BY runid) > 2 AS filt_g_20_detections, detid IN (SELECT detid FROM ({HOT})) AS filt_hot_pixel FROM m JOIN named n USING (cluster_label)""", "regions", m0=MEASURED, m=KEYED, rect=RECT, named=NAMED))
def q_detections_full(s, d):
    r = keyed(s, d)
    features = r.select("detid", *[(((F.col("region") * (k + 3)) % (40 + k)) / float(k + 2)).alias(c) for k, c in enumerate(K.CURVE_COLUMNS)])
    hot = P.hot_flag(P.quality_flags(r, EXCLUDED, 2), rectangles(s))
    flags = hot.select("detid", F.col("low_counts").alias("filt_tbin_5_n_l_5"), F.col("excluded").alias("filt_exclude_obsid"), P.five_sigma().passed().alias("filt_5sig"), F.col("crowded_run").alias("filt_g_20_detections"), F.col("is_hot").alias("filt_hot_pixel"))
    out = K.full_detections(r, features, flags)
    return out.withColumns({"ra_deg": F.round("ra_deg", 6), "dec_deg": F.round("dec_deg", 6), "mean_pixel_intensity": F.round("mean_pixel_intensity", 9)})


#: Columns of the external catalogues of the tests: text for names, the catalogue's flag, positions, else numbers.
TEXT, PLACES = ("main_id", "main_type", "DR3Name", "XMMOM", "IAUNAME"), {"ra": "ra_deg", "dec": "dec_deg", "RAdeg": "ra_deg", "DEdeg": "dec_deg", "RAJ2000": "ra_deg", "DEJ2000": "dec_deg", "SC_RA": "ra_deg", "SC_DEC": "dec_deg"}


def _external_sql(prefix: str) -> str:
    out = []
    for k, c in enumerate(K.EXTERNAL_COLUMNS[prefix]):
        null = lambda x: f"CASE WHEN e.sep <= 20 THEN {x} END" if prefix == "DR14" else x  # noqa: B023, E731
        if c == "SEP_ARCSEC":
            out.append(f"{null('e.sep')} AS {prefix}_{c}")
        elif c in TEXT:
            out.append(null(f"'{c}-' || e.cat_id") + f" AS {prefix}_{c}")
        elif c in PLACES:
            out.append(null(f"round(e.{PLACES[c]}, 6)") + f" AS {prefix}_{c}")
        elif c in ("VarFlag", "SC_VAR_FLAG"):
            out.append((f"coalesce(e.sep <= 20 AND e.var_flag, false)" if prefix == "DR14" else "e.var_flag") + f" AS {prefix}_{c}")
        elif c in ("SRCID", "ID", "Nobs"):
            out.append((f"CASE WHEN e.sep <= 20 THEN e.cat_id * {k} ELSE 0 END" if prefix == "DR14" else f"e.cat_id * {k}") + f" AS {prefix}_{c}")
        else:
            out.append(null(f"e.flux / {k + 1}.0::DOUBLE") + f" AS {prefix}_{c}")
    return f"SELECT n.cluster_label AS region_num, {', '.join(out)} FROM named n LEFT JOIN (SELECT * FROM best WHERE cat_id % 4 <> {list(K.EXTERNAL_COLUMNS).index(prefix)}) e USING (cluster_label)"


BEST = """SELECT cluster_label, cat_id, sep, c.ra_deg, c.dec_deg, c.flux, c.var_flag FROM (SELECT m.cluster_label, cat_id, sep, row_number() OVER (PARTITION BY m.cluster_label ORDER BY sep, cat_id) AS r FROM pairs JOIN m USING (region) WHERE sep <= 60) JOIN catalogue c USING (cat_id) WHERE r = 1"""


@query(put("SELECT n.cluster_label AS region_num, n.srcid, round(n.ra, 6) AS ra_deg, round(n.dec, 6) AS dec_deg, n.n AS n_detections, a.* EXCLUDE region_num, b.* EXCLUDE region_num, c.* EXCLUDE region_num, d.* EXCLUDE region_num FROM named n "
    + " ".join(f"JOIN ({_external_sql(p)}) {t} ON {t}.region_num = n.cluster_label" for t, p in zip("abcd", K.EXTERNAL_COLUMNS, strict=True)), "pairs", m=MEASURED, named=NAMED, best=BEST))
def q_sources_full(s, d):
    r = measured(s, d)
    pairs = C.within(r, A.catalogue(s, d), 60.0).join(r.select("region", "cluster_label"), "region").select("cluster_label", "cat_id", "sep")
    best = C.closest(pairs, "cluster_label").join(A.catalogue(s, d), "cat_id")

    def column(k: int, c: str):
        if c == "SEP_ARCSEC":
            return F.col("sep").alias(c)
        if c in TEXT:
            return F.concat(F.lit(f"{c}-"), F.col("cat_id").cast("string")).alias(c)
        if c in PLACES:
            return F.round(PLACES[c], 6).alias(c)
        if c in ("VarFlag", "SC_VAR_FLAG"):
            return F.col("var_flag").alias(c)
        return (F.col("cat_id") * k if c in ("SRCID", "ID", "Nobs") else F.col("flux") / float(k + 1)).alias(c)

    matches = {p: best.where(F.col("cat_id") % 4 != n).select("cluster_label", *[column(k, c) for k, c in enumerate(names)]) for n, (p, names) in enumerate(K.EXTERNAL_COLUMNS.items())}
    return K.full_sources(r, matches).withColumns({"ra_deg": F.round("ra_deg", 6), "dec_deg": F.round("dec_deg", 6)})


#: Bursts put into the events of the runs: every 97th event comes eighty times, those of one pixel sixty times, so that frames without them are dips.
BURSTS = "SELECT p.*, unnest(range(CASE WHEN event_id % 97 = 0 THEN 80 WHEN ix = 3 AND iy = 0 THEN 60 ELSE 1 END)) AS nth FROM photons p"
#: A "second" of the runs is 72, so frames are 6 to 20 hours and bins of the hard curve 6.
SECOND = 72_000_000
RUN_SOURCES = "SELECT obsid, (source * 37) % 40 AS sx, (source * 53) % 25 AS sy, total_rate / 20 AS rate FROM known"
RUNS = {
    "lists": SOURCE_LISTS,
    "known": KNOWN,
    "sources": RUN_SOURCES,
    "bursts": BURSTS,
    "timed": f"SELECT obsid || '_' || t_bin AS obsid, obsid AS obs, t_bin, ccdnr, t_us // (t_bin::BIGINT * {SECOND}) AS it FROM bursts, (SELECT unnest([300, 600, 1000]) AS t_bin)",
    "hard": f"SELECT f.obsid, f.it, coalesce(h.n, 0) AS n FROM (SELECT obsid, unnest(range(min(t_us // {300 * SECOND}), max(t_us // {300 * SECOND}) + 1)) AS it FROM bursts GROUP BY obsid) f LEFT JOIN (SELECT obsid, t_us // {300 * SECOND} AS it, count(*) AS n FROM bursts WHERE pi > 10000 AND pi < 12000 GROUP BY ALL) h USING (obsid, it)",
    "bti": PARTS["bti"][1].replace("n > 0", "n > 1"),
    "bt": f"SELECT b.obsid || '_' || t_bin AS timed, start * {300 * SECOND} AS start, stop * {300 * SECOND} AS stop FROM bti b, (SELECT unnest([300, 600, 1000]) AS t_bin)",
    "spans": "SELECT obsid, any_value(obs) AS obs, any_value(t_bin) AS t_bin, min(it) AS lo, max(it) AS hi FROM timed GROUP BY obsid",
    "edges": f"SELECT obsid, lo, it, it * t_bin * {SECOND} AS t FROM (SELECT obsid, lo, t_bin::BIGINT AS t_bin, unnest(range(lo, hi + 2)) AS it FROM spans)",
    "bins": "SELECT DISTINCT obsid, lo + unnest(range(a, b)) AS it FROM (SELECT e.obsid, e.lo, b.start, b.stop, count(*) FILTER (e.t < b.start) AS a, count(*) FILTER (e.t < b.stop) - 1 AS b FROM bt b JOIN edges e ON e.obsid = b.timed GROUP BY ALL) WHERE b > a",
    "ccd": CCD_FRAMES.replace(f"t_us // {FRAME}", "it").replace("photons", "timed"),
    "fx": "SELECT c.obsid, s.obs, c.it, c.is_bad, b.it IS NOT NULL AS is_bti FROM ccd c JOIN spans s USING (obsid) LEFT JOIN bins b ON b.obsid = c.obsid AND b.it = c.it",
    "cells": f"""SELECT c.obsid, c.timed, c.obs, c.ix, c.iy, c.it, f.is_bti, count(*) AS n FROM (SELECT obsid || '_0_' || t_bin || '_' || e_lo || '_' || e_hi AS obsid, obsid || '_' || t_bin AS timed, obsid AS obs, ix, iy, t_us // (t_bin::BIGINT * {SECOND}) AS it FROM bursts, (SELECT unnest([300, 600, 1000]) AS t_bin),
        (SELECT unnest([0.2, 2.0, 0.2])::DOUBLE AS e_lo, unnest([2.0, 12.0, 12.0])::DOUBLE AS e_hi) WHERE pi > e_lo * 1000 AND pi < e_hi * 1000) c JOIN fx f ON f.obsid = c.timed AND f.it = c.it WHERE NOT f.is_bad GROUP BY ALL""",
    "rr": "SELECT * FROM (SELECT DISTINCT obsid, timed, obs FROM cells) JOIN (SELECT obsid AS timed, count(*) AS frames, count(*) FILTER (NOT is_bti) AS gti, count(*) FILTER (is_bti) AS bti, count(*) FILTER (is_bad) AS part, count(*) FILTER (NOT is_bti AND NOT is_bad) AS xg, count(*) FILTER (is_bti AND NOT is_bad) AS xb FROM fx GROUP BY obsid) USING (timed)",
    "b0": "SELECT obsid, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM cells GROUP BY obsid",
    "listed": "SELECT DISTINCT r.obsid, sx + dx AS ix, sy + dy AS iy FROM rr r JOIN sources s ON s.obsid = r.obs JOIN b0 ON b0.obsid = r.obsid, (SELECT unnest(range(-4, 5)) AS dx), (SELECT unnest(range(-4, 5)) AS dy) WHERE dx * dx + dy * dy < pow(CASE WHEN rate > 1 THEN 4 WHEN rate > 0.1 THEN 2 ELSE 1 END, 2) AND sx + dx BETWEEN x0 AND x1 AND sy + dy BETWEEN y0 AND y1",
    "rest": """SELECT g.obsid, g.ix, g.iy, coalesce(c.n, 0) AS total FROM (SELECT x.obsid, x.ix, unnest(range(y0, y1 + 1)) AS iy FROM (SELECT obsid, y0, y1, unnest(range(x0, x1 + 1)) AS ix FROM b0) x) g
        LEFT JOIN (SELECT obsid, ix, iy, sum(n) AS n FROM cells WHERE NOT is_bti GROUP BY ALL) c USING (obsid, ix, iy) WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.obsid = g.obsid AND l.ix = g.ix AND l.iy = g.iy)""",
    "rmask": "SELECT obsid, ix, iy FROM listed UNION SELECT r.obsid, ix, iy FROM rest r JOIN (SELECT obsid, quantile_cont(total, 0.75) AS q FROM rest GROUP BY obsid) USING (obsid) WHERE total > 3 * q",
    "image": "SELECT obsid || '|' || is_bti AS obsid, obsid AS run, is_bti, ix, iy, CAST(sum(n) AS BIGINT) AS total FROM cells GROUP BY ALL",
    "kmask": "SELECT k.obsid, m.ix, m.iy FROM rmask m JOIN (SELECT DISTINCT obsid, run FROM image) k ON k.run = m.obsid",
    **template_parts("image", "kmask", "SELECT k.obsid, x0, x1, y0, y1 FROM b0 JOIN (SELECT DISTINCT obsid, run FROM image) k ON k.run = b0.obsid"),
    "outs": "SELECT i.obsid, sum(total) FILTER (m.obsid IS NULL) AS o FROM image i LEFT JOIN rmask m ON m.obsid = i.run AND m.ix = i.ix AND m.iy = i.iy GROUP BY i.obsid",
    "rates": """SELECT i.run, i.ix, i.iy, greatest(0, i.total - t.template * coalesce(o.o, 0)) / (CASE WHEN r.gti > r.bti THEN r.xg ELSE r.xb END) AS rate FROM image i JOIN rr r ON r.obsid = i.run AND i.is_bti = (r.gti <= r.bti)
        JOIN rmask m ON m.obsid = i.run AND m.ix = i.ix AND m.iy = i.iy JOIN template t ON t.obsid = i.obsid AND t.ix = i.ix AND t.iy = i.iy LEFT JOIN outs o ON o.obsid = i.obsid""",
    "model": "SELECT i.run, i.is_bti, i.ix, i.iy, t.template, coalesce(r.rate, 0) AS rate FROM image i JOIN template t USING (obsid, ix, iy) LEFT JOIN rates r ON r.run = i.run AND r.ix = i.ix AND r.iy = i.iy",
    "curve": "SELECT c.obsid, c.it, c.is_bti, coalesce(sum(c.n) FILTER (m.obsid IS NULL), 0) AS o FROM cells c LEFT JOIN rmask m USING (obsid, ix, iy) GROUP BY c.obsid, c.it, c.is_bti",
    "full_": "SELECT m.run AS obsid, m.ix, m.iy, f.it, coalesce(c.n, 0) AS n, m.template * f.o + m.rate AS mu FROM model m JOIN curve f ON f.obsid = m.run AND f.is_bti = m.is_bti LEFT JOIN cells c ON c.obsid = m.run AND c.ix = m.ix AND c.iy = m.iy AND c.it = f.it",
    "hits": """SELECT obsid, ix, iy, it, n, mu, coalesce(n > p, false) AS is_peak, coalesce(n < e, false) AS is_eclipse FROM (
        SELECT c.*, a.n_peak + (b.n_peak - a.n_peak) * (c.mu - a.mu) / (b.mu - a.mu) AS p, a.n_eclipse + (b.n_eclipse - a.n_eclipse) * (c.mu - a.mu) / (b.mu - a.mu) AS e FROM full_ c ASOF LEFT JOIN knots a ON c.mu >= a.mu LEFT JOIN knots b ON b.k = a.k + 1) WHERE n > p OR n < e""",
}
RUN_PARTS = RUNS | {
    "flagged": "SELECT h.obsid, h.ix, h.iy, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT obsid, ix, iy FROM hits) h LEFT JOIN cells c USING (obsid, ix, iy) GROUP BY ALL",
    "reach": REACH,
    "parts": COMPONENTS,
    "found": "SELECT obsid, label, min(ix) AS a, min(iy) AS b, max(ix) AS e, max(iy) AS f, count(*) AS area, CAST(sum(total) AS BIGINT) AS total, (sum(ix * total) / sum(total))::DOUBLE AS wx, (sum(iy * total) / sum(total))::DOUBLE AS wy FROM parts GROUP BY obsid, label",
}


def pipeline_of(s, d) -> TransientPipeline:
    times = F.sequence(F.lit(1), F.when(F.col("event_id") % 97 == 0, 80).when((F.col("ix") == 3) & (F.col("iy") == 0), 60).otherwise(1))
    events = A.photons(s, d).withColumn("nth", F.explode(times)).drop("nth")
    sources = background.known_sources(A.source_lists(s, d)).select("obsid", (F.col("source") * 37 % 40).alias("sx"), (F.col("source") * 53 % 25).alias("sy"), (F.col("total_rate") / 20).alias("rate"))
    plane = wcs_of(s, d).select("obsid", "crval_x", "crval_y", F.lit(5.0).alias("crpix_x"), F.lit(3.0).alias("crpix_y"), F.lit(-0.005).alias("cdelt_x"), F.lit(0.005).alias("cdelt_y"))
    # more than one hard event in a bin is bad
    return TransientPipeline(events, bayes.limit_table(s, 3), frame_scale_us=SECOND, hard_rate=1.5 / 21_600, hard_bin=300, good_times_only=False, sources=sources, wcs=plane)


@query(put("SELECT obsid AS runid, ix, iy, it, n, round(mu, 6) AS mu, is_peak, is_eclipse FROM hits", "photons", "knots", **RUNS))
def q_run_alerts(s, d):
    return pipeline_of(s, d).alerts().select(F.col("obsid").alias("runid"), "ix", "iy", "it", "n", F.round("mu", 6).alias("mu"), "is_peak", "is_eclipse")


@query(put("SELECT run AS runid, is_bti, ix, iy, round(template, 9) AS template, round(rate, 9) AS rate FROM model", "photons", "knots", **RUNS))
def q_run_model(s, d):
    """Templates and source rates of all runs."""
    return pipeline_of(s, d).model().select(F.col("obsid").alias("runid"), "is_bti", "ix", "iy", F.round("template", 9).alias("template"), F.round("rate", 9).alias("rate"))


@query(put("SELECT c.*, coalesce(h.n_peaks, 0) AS n_peaks, coalesce(h.n_eclipses, 0) AS n_eclipses, coalesce(g.n, 0) AS n_regions FROM (SELECT obsid AS runid, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS max_n FROM cells GROUP BY obsid) c LEFT JOIN (SELECT obsid AS runid, count(*) FILTER (is_peak) AS n_peaks, count(*) FILTER (is_eclipse) AS n_eclipses FROM hits GROUP BY obsid) h USING (runid) LEFT JOIN (SELECT obsid AS runid, count(*) AS n FROM found GROUP BY obsid) g USING (runid)", "photons", "knots", **RUN_PARTS))
def q_run_info(s, d):
    return pipeline_of(s, d).info()


@query(put("""SELECT f.obsid AS runid, label, area, total, round((degrees(atan2(xi, down)) + crval_x) % 360.0, 6) AS ra, round(degrees(atan2(sin(d0) + eta * cos(d0), sqrt(xi * xi + down * down))), 6) AS dec FROM (
    SELECT f.*, crval_x, radians(crval_y) AS d0, radians((wx + 1 - 5.0) * -0.005) AS xi, radians((wy + 1 - 3.0) * 0.005) AS eta, cos(radians(crval_y)) - radians((wy + 1 - 3.0) * 0.005) * sin(radians(crval_y)) AS down
    FROM found f JOIN rr USING (obsid) JOIN wcs w ON w.obsid = rr.obs) f""", "photons", "knots", **RUN_PARTS, wcs=WCS))
def q_run_regions(s, d):
    found = pipeline_of(s, d).regions()
    return found.select("runid", "label", "area", F.round(F.col("intensity_mean") * F.col("area")).cast("long").alias("total"), F.round("ra_deg", 6).alias("ra"), F.round("dec_deg", 6).alias("dec"))


#: Light curves of the runs' regions, unrounded.
RUN_CURVES = """SELECT g.obsid AS runid, g.label, x.it, coalesce(n.n, 0) AS n, CASE WHEN k.o IS NULL THEN 0 ELSE coalesce(m.t, 0) * k.o + coalesce(m.r, 0) END AS mu, x.is_bti
    FROM found g JOIN rr USING (obsid) JOIN fx x ON x.obsid = rr.timed AND NOT x.is_bad LEFT JOIN curve k ON k.obsid = g.obsid AND k.it = x.it
    LEFT JOIN (SELECT g.obsid, g.label, m.is_bti, sum(template) AS t, sum(rate) AS r FROM found g JOIN model m ON m.run = g.obsid AND m.ix BETWEEN g.a AND g.e AND m.iy BETWEEN g.b AND g.f GROUP BY ALL) m ON m.obsid = g.obsid AND m.label = g.label AND m.is_bti = x.is_bti
    LEFT JOIN (SELECT g.obsid, g.label, c.it, CAST(sum(c.n) AS BIGINT) AS n FROM found g JOIN cells c ON c.obsid = g.obsid AND c.ix BETWEEN g.a AND g.e AND c.iy BETWEEN g.b AND g.f GROUP BY ALL) n ON n.obsid = g.obsid AND n.label = g.label AND n.it = x.it"""
#: Factors of their bins, and of each curve the greatest.
RUN_FACTORS = {
    "curves": RUN_CURVES,
    "lc_bins": f"SELECT *, CASE WHEN mu > 0 THEN {factor('peak')} END AS bp, CASE WHEN mu > 0 THEN {factor('eclipse')} END AS be FROM curves",
    "tops": "SELECT runid, label, 'p' AS kind, round(max(bp), 9) AS b FROM lc_bins GROUP BY ALL UNION ALL SELECT runid, label, 'e', round(max(be), 9) FROM lc_bins GROUP BY ALL",
    "ends": SIGMA_ENDS,
    "sigmas": "SELECT f.runid, f.label, f.kind, CASE WHEN f.b < CASE f.kind WHEN 'p' THEN x.p1 ELSE x.e1 END THEN 0.0::DOUBLE WHEN f.b >= CASE f.kind WHEN 'p' THEN x.p10 ELSE x.e10 END THEN 10.0::DOUBLE ELSE t.sigma END AS sigma FROM tops f ASOF LEFT JOIN stairs t ON f.kind = t.kind AND f.b <= t.b, ends x",
    "moments": """SELECT runid, label, count(*) AS len, max(n) AS n_max, min(n) AS n_min, CAST(sum(n) AS BIGINT) AS n_sum, avg(n) AS n_mean, stddev_samp(n) AS n_std, count(*) FILTER (is_bti) / count(*)::DOUBLE AS ratio_bti,
        m3 / count(*) / pow(m2 / count(*), 1.5) AS n_skew, m4 / count(*) / pow(m2 / count(*), 2) - 3 AS n_kurt FROM (SELECT *, sum(pow(n - a, 2)) OVER w AS m2, sum(pow(n - a, 3)) OVER w AS m3, sum(pow(n - a, 4)) OVER w AS m4 FROM (SELECT *, avg(n) OVER (PARTITION BY runid, label) AS a FROM curves) WINDOW w AS (PARTITION BY runid, label)) GROUP BY runid, label, m2, m3, m4""",
    "distant": "SELECT runid, label, count(*) FILTER (gap > 5) + 1 AS k FROM (SELECT *, it - lag(it) OVER (PARTITION BY runid, label ORDER BY it) AS gap FROM lc_bins WHERE bp > 6.4 OR be > 5.5) GROUP BY ALL",
    "ksd": KS.replace(", 9) AS ks", ", 12) AS ks"),
    "ksp": "SELECT runid, label, CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1, k - 1) * exp(-2 * k * k * lam * lam))))) END::DOUBLE AS p FROM (SELECT *, ks * sqrt(len / 2.0::DOUBLE) AS lam FROM ksd)",
}


@query(put("SELECT runid, label, it, n, round(mu, 6) AS mu, is_bti FROM curves", "photons", "knots", **RUN_PARTS, curves=RUN_CURVES))
def q_run_light_curves(s, d):
    return pipeline_of(s, d).light_curves().select("runid", "label", "it", "n", F.round("mu", 6).alias("mu"), "is_bti")


@query(put("""SELECT m.runid, m.label, n_max, n_min, n_sum, round(n_mean, 6) AS n_mean, round(n_std, 6) AS n_std, round(n_skew, 5) AS n_skew, round(n_kurt, 5) AS n_kurt, round(p.sigma, 6) AS sigma_max_B_peak, round(e.sigma, 6) AS sigma_max_B_eclipse,
    round(ratio_bti, 9) AS ratio_bti, coalesce(d.k, 0) AS n_peaks, round(k.p, 5) AS ks_pval FROM moments m JOIN sigmas p ON p.runid = m.runid AND p.label = m.label AND p.kind = 'p' JOIN sigmas e ON e.runid = m.runid AND e.label = m.label AND e.kind = 'e'
    JOIN ksp k ON k.runid = m.runid AND k.label = m.label LEFT JOIN distant d ON d.runid = m.runid AND d.label = m.label""", "photons", "knots", "stairs", **RUN_PARTS, **RUN_FACTORS))
def q_run_features(s, d):
    """The catalogue's features of every detection's light curve."""
    rounded = {"n_mean": 6, "n_std": 6, "n_skew": 5, "n_kurt": 5, "sigma_max_B_peak": 6, "sigma_max_B_eclipse": 6, "ratio_bti": 9, "ks_pval": 5}
    found = pipeline_of(s, d).features().drop("bin_min_between_peaks", "b_peak_max", "b_eclipse_max")
    return found.withColumns({c: F.round(c, k) for c, k in rounded.items()})


@query(put(f"""SELECT h.obsid AS runid, h.ix, h.iy, h.it, count(*) AS n_events, max(pi) AS pi_max FROM hits h JOIN (SELECT obsid || '_0_' || t_bin || '_' || e_lo || '_' || e_hi AS obsid, ix, iy, pi, t_us // (t_bin::BIGINT * {SECOND}) AS it FROM bursts, (SELECT unnest([300, 600, 1000]) AS t_bin),
    (SELECT unnest([0.2, 2.0, 0.2])::DOUBLE AS e_lo, unnest([2.0, 12.0, 12.0])::DOUBLE AS e_hi) WHERE pi > e_lo * 1000 AND pi < e_hi * 1000) e USING (obsid, ix, iy, it) GROUP BY ALL""", "photons", "knots", **RUNS))
def q_run_alert_events(s, d):
    return pipeline_of(s, d).alert_events().groupBy("runid", "ix", "iy", "it").agg(F.count("*").alias("n_events"), F.max("pi").alias("pi_max"))


@query(put("SELECT r.obsid AS runid, x1 - x0 + 1 AS n_x, y1 - y0 + 1 AS n_y, frames AS n_frames, gti AS n_gti, bti AS n_bti, part AS n_partial FROM rr r JOIN b0 USING (obsid)", "photons", "knots", **RUNS))
def q_run_cubes(s, d):
    return pipeline_of(s, d).cube_info().select("runid", "n_x", "n_y", "n_frames", "n_gti", "n_bti", "n_partial")


def _fits_of(df, name: str) -> str:
    path = store.scratch(df.sparkSession, name)
    fits.write_table(df, path, 2000)
    return path


@query(put("SELECT obsid, ccdnr, count(*) AS n, CAST(sum(pi) AS BIGINT) AS pi_sum, min(t_us) AS t_min, max(t_us) AS t_max, max(instrument) AS last_instrument FROM photons GROUP BY ALL", "photons"))
def q_fits_events(s, d):
    """Event lists written as FITS tables and read back, five of thirteen columns."""
    events = fits.read_table(s, _fits_of(A.photons(s, d), "events"), "obsid string, ccdnr long, pi int, t_us long, instrument string", 700)
    return events.groupBy("obsid", "ccdnr").agg(F.count("*").alias("n"), F.sum("pi").alias("pi_sum"), F.min("t_us").alias("t_min"), F.max("t_us").alias("t_max"), F.max("instrument").alias("last_instrument"))


@query(put("SELECT count(*) AS n_rows, 13 AS n_columns, 'event_id' AS first_column FROM photons", "photons"))
def q_fits_headers(s, d):
    """What the headers alone say of all files."""
    card = lambda c: F.element_at("header", F.lit(c))
    heads = fits.read_headers(s, _fits_of(A.photons(s, d), "events"))
    return heads.agg(F.sum(card("NAXIS2").cast("long")).alias("n_rows"), F.max(card("TFIELDS").cast("int")).alias("n_columns"), F.max(card("TTYPE1")).alias("first_column"))


@query(put("SELECT source, obsid, kind, round(radius, 6) AS radius FROM known", lists=SOURCE_LISTS, known=KNOWN))
def q_fits_sources(s, d):
    """Known sources of source lists in FITS files."""
    lists = fits.read_table(s, _fits_of(A.source_lists(s, d), "lists"), fits.SOURCE_LIST)
    return background.known_sources(lists).select("source", "obsid", "kind", F.round("radius", 6).alias("radius"))


@query(put("SELECT region, cat_id, sep FROM pairs WHERE sep <= 20.0", "pairs"))
def q_fits_catalogue(s, d):
    """A catalogue in a FITS file, matched."""
    catalogue = fits.read_table(s, _fits_of(A.catalogue(s, d).drop("var_flag"), "catalogue"), fits.CATALOGUE)
    return C.within(A.regions(s, d), catalogue, 20.0).select("region", "cat_id", "sep")
