"""Queries on the sphere: matches, clusters, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import crossmatch as C
from ..operators import statistics as S
from ..sources import adapters as A
from .oracle import SEP, put

REGISTER: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTER[f.__name__] = (f, sql)
        return f

    return add


@query(put("SELECT region, cat_id, sep, ra_offset, dec_offset FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY sep, cat_id) AS r FROM pairs) WHERE r = 1", "pairs"))
def q_crossmatch_nearest(s, d):
    return C.nearest(A.regions(s, d), A.catalogue(s, d))


@query(put("SELECT region, cat_id, sep, ra_offset, dec_offset FROM pairs WHERE sep <= 20.0", "pairs"))
def q_crossmatch_radius(s, d):
    return C.within(A.regions(s, d), A.catalogue(s, d), 20.0)


CLOSEST = """SELECT region, cat_id, sep, ra_offset, dec_offset, coalesce(sep, 9999.0::DOUBLE) AS sep_or_none FROM (SELECT region FROM regions) LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY sep, cat_id) AS r FROM pairs WHERE sep <= 20.0) WHERE r = 1) USING (region)"""


def matched(s, d):
    return C.nearest_or_none(A.regions(s, d), A.catalogue(s, d), 20.0)


@query(put(CLOSEST, "pairs"))
def q_closest_with_nomatch(s, d):
    return matched(s, d)


@query(put("SELECT region FROM regions EXCEPT SELECT region FROM pairs WHERE sep <= 20.0", "pairs"))
def q_unmatched(s, d):
    return A.regions(s, d).select("region").join(C.within(A.regions(s, d), A.catalogue(s, d), 20.0), "region", "left_anti")


@query(put(f"""SELECT count(*) AS n, count(*) FILTER (sep_or_none < 20) AS n_20, count(*) FILTER (sep_or_none < 10) AS n_10, round(avg(ra_offset) * 3600, 6) AS mean_ra, round(stddev_samp(ra_offset) * 3600, 6) AS std_ra,
    round(avg(dec_offset) * 3600, 6) AS mean_dec, round(stddev_samp(dec_offset) * 3600, 6) AS std_dec FROM ({CLOSEST})""", "pairs"))
def q_crossmatch_numbers(s, d):
    r = lambda c: F.round(c * 3600, 6)
    return matched(s, d).agg(
        F.count("*").alias("n"), F.count_if(F.col("sep_or_none") < 20).alias("n_20"), F.count_if(F.col("sep_or_none") < 10).alias("n_10"),
        r(F.avg("ra_offset")).alias("mean_ra"), r(F.stddev_samp("ra_offset")).alias("std_ra"), r(F.avg("dec_offset")).alias("mean_dec"), r(F.stddev_samp("dec_offset")).alias("std_dec"),
    )


TAGGED = "SELECT CASE t_bin WHEN 5 THEN 'a' WHEN 50 THEN 'b' ELSE 'c' END AS key, * FROM regions"
RUN_PAIRS = f"""SELECT g.k1, g.region, g.k2, CASE WHEN g.k1 = g.k2 THEN g.region ELSE coalesce(m.match, -1) END AS match FROM (SELECT t.key AS k1, region, k.key AS k2 FROM tagged t, (SELECT DISTINCT key FROM tagged) k) g
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1, region, k2 ORDER BY sep, match) AS n FROM (
      SELECT r.key AS k1, r.region, c.key AS k2, c.region AS match, round({SEP}, 6) AS sep FROM tagged r, tagged c WHERE r.key <> c.key) WHERE sep <= 15.0) WHERE n = 1) m ON m.k1 = g.k1 AND m.region = g.region AND m.k2 = g.k2"""


def tagged(s, d):
    return A.regions(s, d).withColumn("key", F.when(F.col("t_bin") == 5, "a").when(F.col("t_bin") == 50, "b").otherwise("c"))


@query(put(RUN_PAIRS, "regions", tagged=TAGGED))
def q_run_pair_matches(s, d):
    return C.between_runs(tagged(s, d))


@query(put(f"""SELECT k1, round(avg((match > -1)::INT) FILTER (k2 = 'a'), 9) AS a, round(avg((match > -1)::INT) FILTER (k2 = 'b'), 9) AS b, round(avg((match > -1)::INT) FILTER (k2 = 'c'), 9) AS c FROM ({RUN_PAIRS}) GROUP BY k1""", "regions", tagged=TAGGED))
def q_match_fraction(s, d):
    return S.match_fractions(C.between_runs(tagged(s, d)))


@query(put("""SELECT key, n_regions, n_runs, mean_c, std_c FROM (SELECT key, count(*) AS n_regions, count(DISTINCT runid) AS n_runs FROM tagged GROUP BY key) JOIN (
    SELECT key, round(avg(c), 9) AS mean_c, round(stddev_samp(c), 9) AS std_c FROM (SELECT key, obsid, count(*) AS c FROM tagged GROUP BY ALL) GROUP BY key) USING (key)""", "regions", tagged=TAGGED))
def q_run_subset_stats(s, d):
    return S.run_statistics(tagged(s, d))


@query(put("SELECT first, ra_deg, dec_deg, n_chosen, array_to_string(members, ',') AS members FROM unique_sources", "unique_sources"))
def q_cluster_regions(s, d):
    return C.cluster(A.regions(s, d)).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query(put("SELECT row_number() OVER (ORDER BY first) - 1 AS cluster_label, first, n_chosen FROM unique_sources", "unique_sources"))
def q_cluster_labels(s, d):
    """Unique sources numbered in the order of their first region."""
    return C.numbered(C.unique_sources(A.regions(s, d))).select("cluster_label", "first", "n_chosen")


@query(put(f"SELECT r.region, round({SEP}, 6) AS sep, round((r.ra_deg - c.ra_deg) * cos(radians(r.dec_deg)), 9) AS dra FROM regions r JOIN regions c ON c.region = r.region + 1", "regions"))
def q_separations(s, d):
    r = A.regions(s, d).select("region", "ra_deg", "dec_deg")
    nxt = r.select((F.col("region") - 1).alias("region"), F.col("ra_deg").alias("ra2"), F.col("dec_deg").alias("dec2"))
    dra, _ = G.offsets(F.col("ra_deg"), F.col("dec_deg"), F.col("ra2"), F.col("dec2"))
    return r.join(nxt, "region").select("region", F.round(G.separation(F.col("ra_deg"), F.col("dec_deg"), F.col("ra2"), F.col("dec2")), 6).alias("sep"), F.round(dra, 9).alias("dra"))


@query(put("""SELECT region, round(25719.0 + (x_img - 25719.0) * cos(radians(-label * 10)) - (y_img - 25719.0) * sin(radians(-label * 10)), 6) AS x_det,
    round(25719.0 + (x_img - 25719.0) * sin(radians(-label * 10)) + (y_img - 25719.0) * cos(radians(-label * 10)), 6) AS y_det FROM regions""", "regions"))
def q_detector_frame(s, d):
    x, y = G.rotate(F.col("x_img"), F.col("y_img"), F.col("label") * 10)
    return A.regions(s, d).select("region", F.round(x, 6).alias("x_det"), F.round(y, 6).alias("y_det"))


@query(put("""SELECT region, 'J' || lpad(CAST(t // 36000 AS VARCHAR), 2, '0') || lpad(CAST(t // 600 % 60 AS VARCHAR), 2, '0') || lpad(CAST(t // 10 % 60 AS VARCHAR), 2, '0') || '.' || (t % 10) || CASE WHEN dec_deg < 0 THEN '-' ELSE '+' END
    || lpad(CAST(a // 3600 AS VARCHAR), 2, '0') || lpad(CAST(a // 60 % 60 AS VARCHAR), 2, '0') || lpad(CAST(a % 60 AS VARCHAR), 2, '0') AS name
    FROM (SELECT *, CAST(floor(round(ra_deg / 15 * 36000, 4)) AS BIGINT) AS t, CAST(floor(round(abs(dec_deg) * 3600, 4)) AS BIGINT) AS a FROM regions)""", "regions"))
def q_iau_names(s, d):
    return A.regions(s, d).select("region", G.iau_name(F.col("ra_deg"), F.col("dec_deg")).alias("name"))


@query(put("""SELECT region, round(degrees(asin(sin(radians(dec_deg)) * sin(radians(27.12825)) + cos(radians(dec_deg)) * cos(radians(27.12825)) * cos(radians(ra_deg - 192.85948)))), 6) AS b FROM regions""", "regions"))
def q_galactic_latitude(s, d):
    return A.regions(s, d).select("region", F.round(G.to_galactic(F.col("ra_deg"), F.col("dec_deg"))[1], 6).alias("b"))


@query(put("SELECT region, ra_deg, dec_deg FROM regions WHERE ra_deg > 100 AND ra_deg < 200 AND dec_deg > -30 AND dec_deg < 30", "regions"))
def q_sky_box(s, d):
    return A.regions(s, d).where("ra_deg > 100 and ra_deg < 200 and dec_deg > -30 and dec_deg < 30").select("region", "ra_deg", "dec_deg")
