"""Queries on light curves and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bayes
from ..operators import cube
from ..operators import features as X
from .cube_queries import cells_of
from .oracle import TERMS_ECLIPSE, TERMS_PEAK, put, summed

REGISTER: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTER[f.__name__] = (f, sql)
        return f

    return add


def curves_of(s, d) -> DataFrame:
    """A dense light curve of every pixel, with its expectation; every fourth frame counts as bad time."""
    c = cube.dense_expected(cells_of(s, d))
    return c.select(F.col("obsid").alias("runid"), (F.col("ix") * 100 + F.col("iy")).alias("label"), "it", "n", "mu", (F.col("it") % 4 == 0).alias("bti"))


def scored(c: DataFrame) -> DataFrame:
    """Both factors of every bin; equal (n, mu) are scored once."""
    kinds = c.select("n", "mu").distinct()
    kinds = kinds.withColumn("b_peak", F.round(bayes.log_peak(F.col("n"), F.col("mu")), 6)).withColumn("b_eclipse", F.round(bayes.log_eclipse(F.col("n"), F.col("mu")), 6))
    return c.join(kinds, ["n", "mu"])


@query(put("""SELECT runid, label, count(*) AS len, min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS mean_n, round(stddev_samp(n), 6) AS std_n, CAST(sum(n) AS BIGINT) AS sum_n,
    round(m3 / count(*) / pow(m2 / count(*), 1.5), 6) AS skew_n, round(m4 / count(*) / pow(m2 / count(*), 2) - 3, 6) AS kurt_n FROM
    (SELECT *, sum(pow(n - a, 2)) OVER w AS m2, sum(pow(n - a, 3)) OVER w AS m3, sum(pow(n - a, 4)) OVER w AS m4 FROM (SELECT *, avg(n) OVER (PARTITION BY runid, label) AS a FROM curves) WINDOW w AS (PARTITION BY runid, label))
    GROUP BY runid, label, m2, m3, m4""", "curves"))
def q_lc_features(s, d):
    return X.moments(curves_of(s, d)).withColumns({c: F.round(c, 6) for c in ("mean_n", "std_n", "skew_n", "kurt_n")})


#: Flares and dips put into the curves, deep enough for the thresholds of 3 and 5 sigma.
INJECTED = """SELECT runid, label, it, bti, mu + extra + 0.05 AS mu, n + CASE WHEN (it + label) % 11 = 3 THEN 12 + (label % 5) * 6 ELSE 0 END + CASE WHEN extra > 0 AND it % 3 = 1 THEN 30 ELSE 0 END AS n
    FROM (SELECT *, CASE WHEN (it + label) % 7 = 0 THEN 25.0 + (label % 4) * 15 ELSE 0 END::DOUBLE AS extra FROM curves)"""
SCORED = f"SELECT *, round({summed(TERMS_PEAK)}, 6) AS b_peak, round({summed(TERMS_ECLIPSE)}, 6) AS b_eclipse FROM injected"
CUTS = {"peak": (bayes.PEAK_3, bayes.PEAK_5), "eclipse": (bayes.ECLIPSE_3, bayes.ECLIPSE_5)}
BINS = ", ".join(f"count(*) FILTER (b_{k} > {c}::DOUBLE{w}) AS n_{g}_sig_{k}_bins{e}" for k, cs in CUTS.items() for g, c in zip((3, 5), cs, strict=True) for w, e in (("", ""), (" AND bti", "_bti"), (" AND NOT bti", "_gti")))


def injected_of(s, d) -> DataFrame:
    it, label = F.col("it"), F.col("label")
    extra = F.when((it + label) % 7 == 0, 25.0 + (label % 4) * 15).otherwise(0.0)
    flare = F.when((it + label) % 11 == 3, 12 + (label % 5) * 6).otherwise(0)
    c = curves_of(s, d).withColumn("extra", extra)
    n = F.col("n") + flare + F.when((F.col("extra") > 0) & (it % 3 == 1), 30).otherwise(0)
    return c.select("runid", "label", "it", "bti", (F.col("mu") + F.col("extra") + 0.05).alias("mu"), n.alias("n"))


@query(put(f"SELECT runid, label, {BINS} FROM s GROUP BY ALL", "curves", injected=INJECTED, s=SCORED))
def q_sig_bins(s, d):
    return X.significant_bins(scored(injected_of(s, d)))


@query(put("""SELECT runid, label, count(*) FILTER (coalesce(n > b AND n > a AND n >= 2, false)) AS n_maxima FROM (SELECT *, lag(n) OVER w AS b, lead(n) OVER w AS a FROM (
    SELECT * FROM (SELECT *, coalesce(n <> lag(n) OVER (PARTITION BY runid, label ORDER BY it), true) AS c FROM curves) WHERE c) WINDOW w AS (PARTITION BY runid, label ORDER BY it)) GROUP BY ALL""", "curves"))
def q_local_maxima(s, d):
    return X.local_maxima(curves_of(s, d), 2)


@query(put("""SELECT runid, label, coalesce(k, 0) AS n_distant FROM (SELECT DISTINCT runid, label FROM curves) LEFT JOIN (SELECT runid, label, count(*) FILTER (gap > 3) + 1 AS k FROM (
    SELECT *, it - lag(it) OVER (PARTITION BY runid, label ORDER BY it) AS gap FROM curves WHERE n > 1) GROUP BY ALL) USING (runid, label)""", "curves"))
def q_distant_peaks(s, d):
    return X.distant_peaks(curves_of(s, d), 1, 3)


@query(put("""SELECT runid, label, coalesce(sum(x), 0) / 2::DOUBLE AS n_crossings FROM (SELECT *, abs((n > 1)::INT - lag((n > 1)::INT) OVER (PARTITION BY runid, label ORDER BY it)) AS x FROM curves) GROUP BY ALL""", "curves"))
def q_crossings(s, d):
    return X.crossings(curves_of(s, d), 1)


@query(put("""SELECT runid, label, it AS idx, n AS peak_n, it = lo AS is_first, it = hi AS is_last, b = 0 AND a = 0 AS isolated FROM (SELECT *, min(it) OVER p AS lo, max(it) OVER p AS hi,
    coalesce(lag(n) OVER w, last_value(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b, coalesce(lead(n) OVER w, first_value(n) OVER w) AS a, row_number() OVER (PARTITION BY runid, label ORDER BY n DESC, it) AS r
    FROM curves WINDOW w AS (PARTITION BY runid, label ORDER BY it), p AS (PARTITION BY runid, label)) WHERE r = 1""", "curves"))
def q_largest_peak(s, d):
    return X.largest_peak(curves_of(s, d))


KS = """SELECT runid, label, round(max(abs(x::DOUBLE / m - y::DOUBLE / m)), 9) AS ks, max(m) AS len FROM (SELECT *, sum(one) OVER (PARTITION BY runid, label) AS m FROM (
    SELECT runid, label, sum(one) OVER w AS x, count(*) OVER w - sum(one) OVER w AS y, one FROM (SELECT runid, label, n::DOUBLE AS v, 1 AS one FROM curves UNION ALL SELECT runid, label, mu, 0 FROM curves)
    WINDOW w AS (PARTITION BY runid, label ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) GROUP BY runid, label"""


@query(put(f"SELECT runid, label, ks, CAST(len AS BIGINT) AS len FROM ({KS})", "curves"))
def q_ks_statistic(s, d):
    return X.ks_statistic(curves_of(s, d)).withColumn("ks", F.round("ks", 9))


@query(put(f"""SELECT runid, label, CAST(len AS BIGINT) AS len, round(CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1, k - 1) * exp(-2 * k * k * lam * lam))))) END::DOUBLE, 6) AS p
    FROM (SELECT *, ks * sqrt(len / 2.0::DOUBLE) AS lam FROM ({KS.replace(", 9) AS ks", ", 12) AS ks")}))""", "curves"))
def q_ks_probability(s, d):
    found = X.ks_statistic(curves_of(s, d)).withColumn("ks", F.round("ks", 12))
    return found.select("runid", "label", "len", F.round(X.ks_probability(F.col("ks"), F.col("len")), 6).alias("p"))


@query(put("""SELECT runid, label, round(max(x), 9) AS d_plus, round(min(x), 9) AS d_minus FROM (SELECT runid, label, (sum(n) OVER w)::DOUBLE / (sum(n) OVER p)::DOUBLE - row_number() OVER w / (count(*) OVER p)::DOUBLE AS x FROM curves
    WINDOW w AS (PARTITION BY runid, label ORDER BY it), p AS (PARTITION BY runid, label)) GROUP BY ALL""", "curves"))
def q_kuiper(s, d):
    return X.kuiper(curves_of(s, d)).withColumn("d_plus", F.round("d_plus", 9)).withColumn("d_minus", F.round("d_minus", 9))


@query(put("""SELECT runid, label, it, n, t0, t0 + shift AS t_shifted FROM (SELECT *, it - min(it) OVER (PARTITION BY runid, label) AS t0 FROM curves) JOIN (
    SELECT runid, CAST(coalesce(sum(span) OVER (ORDER BY runid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM (
      SELECT runid, max(t0) AS span FROM (SELECT runid, it - min(it) OVER (PARTITION BY runid, label) AS t0 FROM curves) GROUP BY runid)) USING (runid)""", "curves"))
def q_lc_shift(s, d):
    return X.end_to_end(curves_of(s, d)).select("runid", "label", "it", "n", "t0", "t_shifted")


@query(put("""SELECT runid, label, m, round(a / (s / sqrt(m)), 6) AS t FROM (SELECT runid, label, count(*) AS m, avg(mu - n) AS a, stddev_samp(mu - n) AS s FROM (
    SELECT *, it - min(it) OVER (PARTITION BY runid, label) AS t0 FROM curves) WHERE t0 < 60 GROUP BY ALL) WHERE s > 0""", "curves"))
def q_paired_t(s, d):
    return X.paired_t(curves_of(s, d), 60).withColumn("t", F.round("t", 6))


@query(put("""SELECT c.obsid, c.ix, c.iy, c.it, CAST(b.n_box AS BIGINT) AS n_box, CAST(f.n_frame - b.n_box AS BIGINT) AS n_rest, CAST(b.box_around AS BIGINT) AS box_around, CAST(f.n_around - b.box_around AS BIGINT) AS rest_around FROM cells c JOIN (
      SELECT *, sum(n_box) OVER (PARTITION BY obsid, ix, iy ORDER BY it RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS box_around FROM (
        SELECT obsid, ix + dx AS ix, iy + dy AS iy, it, sum(n) AS n_box FROM cells, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) GROUP BY ALL)) b USING (obsid, ix, iy, it)
    JOIN (SELECT *, sum(n_frame) OVER (PARTITION BY obsid ORDER BY it RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n_around FROM (SELECT obsid, it, sum(n) AS n_frame FROM cells GROUP BY ALL)) f USING (obsid, it)""", "cells"))
def q_neighbour_box(s, d):
    return X.near_box(cells_of(s, d))


@query(put("SELECT runid, label, it, n, n - min(n) OVER w AS above_min, round(n / nullif(max(n) OVER w, 0)::DOUBLE, 9) AS share_of_max FROM curves WINDOW w AS (PARTITION BY runid, label)", "curves"))
def q_group_transform(s, d):
    lo, hi = F.min("n").over(X.whole()), F.max("n").over(X.whole())
    return curves_of(s, d).select("runid", "label", "it", "n", (F.col("n") - lo).alias("above_min"), F.round(F.col("n") / F.nullif(hi, F.lit(0)), 9).alias("share_of_max"))


@query(put("SELECT runid, label, min(it) AS first_row, max(it) AS last_row, count(*) AS n_rows FROM curves GROUP BY ALL", "curves"))
def q_lc_index(s, d):
    return curves_of(s, d).groupBy("runid", "label").agg(F.min("it").alias("first_row"), F.max("it").alias("last_row"), F.count("*").alias("n_rows"))


@query(put("SELECT runid, round(covar_samp(n, mu), 6) AS cov, round(sqrt(avg(n * n)), 6) AS gyration, round(quantile_cont(n, 0.16), 6) AS q16, round(quantile_cont(n, 0.84), 6) AS q84, mode(n) AS mode_n FROM curves GROUP BY runid", "curves"))
def q_curve_moments(s, d):
    c = curves_of(s, d)
    return c.groupBy("runid").agg(
        F.round(F.covar_samp("n", "mu"), 6).alias("cov"), F.round(F.sqrt(F.avg(F.col("n") * F.col("n"))), 6).alias("gyration"), F.round(F.percentile("n", F.lit(0.16)), 6).alias("q16"), F.round(F.percentile("n", F.lit(0.84)), 6).alias("q84"), F.mode("n").alias("mode_n")
    )


@query(put("""SELECT runid, label, it, round(0.5 * n + 0.3 * coalesce(lag(n, 1) OVER w, 0) + 0.2 * coalesce(lag(n, 2) OVER w, 0), 9)::DOUBLE AS convolved FROM curves WINDOW w AS (PARTITION BY runid, label ORDER BY it)""", "curves"))
def q_convolution(s, d):
    return X.convolved(curves_of(s, d), [0.5, 0.3, 0.2]).select("runid", "label", "it", F.round("convolved", 9).alias("convolved"))
