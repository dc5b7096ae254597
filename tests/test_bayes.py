"""Bayes factors, limits and their inverses against known values."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkburst.functions import bayes, gamma
from sparkburst.plans import registry


@pytest.mark.parametrize(("n", "mu", "expected"), [(0, 2.0, 0.0), (3, 0.1, 3.821579027912009), (12, 4.2, 3.025195243042054)])
def test_peak(spark, n, mu, expected):
    df = spark.createDataFrame([(n, mu)], "n long, mu double")
    assert df.select(bayes.log_peak(F.col("n"), F.col("mu")).alias("b")).first()["b"] == pytest.approx(expected, abs=1e-12)
    assert bayes.log_peak_np(n, mu) == pytest.approx(expected, abs=1e-9)


def test_peak_does_not_overflow(spark):
    df = spark.createDataFrame([(2000, 1e-3)], "n long, mu double")
    assert df.select(bayes.log_peak(F.col("n"), F.col("mu")).alias("b")).first()["b"] == pytest.approx(bayes.log_peak_np(2000, 1e-3), rel=1e-9)


def test_thresholds():
    assert bayes.threshold("peak", 3) == pytest.approx(bayes.PEAK_3, abs=1e-9)
    assert bayes.threshold("peak", 5) == pytest.approx(bayes.PEAK_5, abs=1e-9)
    assert bayes.threshold("eclipse", 3) == pytest.approx(bayes.ECLIPSE_3, abs=1e-9)
    assert bayes.threshold("eclipse", 5) == pytest.approx(bayes.ECLIPSE_5, abs=1e-9)


@pytest.mark.parametrize(("mu", "peak", "eclipse"), [(158.556483, 219, 106), (158.629519, 219, 107)])
def test_limits(mu, peak, eclipse):
    assert bayes.least_peak(mu, bayes.PEAK_3) == peak
    assert bayes.greatest_eclipse(mu, bayes.ECLIPSE_3) == eclipse


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.floats(0.05, 60))
def test_factors_against_sums(n, mu):
    pmf = lambda k: math.exp(-mu + k * math.log(mu) - math.lgamma(k + 1))
    below = sum(pmf(k) for k in range(n + 1))
    above = sum(pmf(k) for k in range(n + 1, n + 400))
    assert bayes.log_peak_np(n, mu) == pytest.approx(math.log10(below / pmf(n)), abs=1e-6)
    assert bayes.log_eclipse_np(n, mu) == pytest.approx(math.log10(above / pmf(n)), abs=1e-6)


def test_significant_and_sigma(spark):
    cells = spark.createDataFrame([(60, 5.0), (5, 5.0), (0, 40.0), (3, 1e-9)], "n long, mu double")
    limits = bayes.limit_table(spark, 3, 300, 10)
    got = [(bool(r["is_peak"]), bool(r["is_eclipse"])) for r in bayes.significant(cells, limits).orderBy("mu").collect()]
    assert sorted(got) == [(False, False), (False, False), (False, True), (True, False)]
    sigma = [r["s"] for r in cells.where("mu > 1").select("n", bayes.sigma_equivalent(F.col("n"), F.col("mu")).alias("s")).collect()]
    assert sigma[0] > 5 and sigma[1] < 1


def test_rate_quantile(spark):
    got = spark.createDataFrame([(0, 0.5), (10, 0.5)], "n long, q double").select(bayes.rate_quantile("n", "q").alias("r")).collect()
    assert got[0]["r"] == pytest.approx(math.log(2), abs=1e-6)
    assert got[1]["r"] == pytest.approx(10.668522, abs=1e-4)


@pytest.mark.parametrize(("n", "mu", "expected"), [(800, 1000.0, 11.18), (200, 300.0, 9.76)])
def test_eclipse_of_bright_pixels(spark, n, mu, expected):
    df = spark.createDataFrame([(n, mu)], "n long, mu double")
    assert df.select(bayes.log_eclipse(F.col("n"), F.col("mu")).alias("b")).first()["b"] == pytest.approx(expected, abs=0.005)


@pytest.mark.parametrize(("n", "mu"), [(0, 1e-7), (0, 2000.0), (1, 30.0), (70, 60.0), (5000, 5000.0), (99_000, 1e5)])
def test_eclipse_against_exact_sums(spark, n, mu):
    j, m = 0, []
    while j < 200 or m[-1] > max(m) - 60:
        j += 1
        m.append((m[-1] if m else 0.0) + math.log(mu) - math.log(n + j))
    top = max(m)
    expected = (top + math.log(math.fsum(math.exp(x - top) for x in m))) / math.log(10)
    df = spark.createDataFrame([(n, mu)], "n long, mu double")
    assert df.select(bayes.log_eclipse(F.col("n"), F.col("mu")).alias("b")).first()["b"] == pytest.approx(expected, abs=1e-8)
    assert bayes.log_eclipse_np(n, mu) == pytest.approx(expected, abs=1e-8)


def test_registered_limits_are_the_whole_grid(spark):
    limits = registry.QUERIES["q_limits"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(limits) == 51_000
    near = {round(10**m, 5): (p, e) for _, m, p, e, _ in limits.itertuples(index=False) if 158.5 < 10**m < 158.7}
    assert near[158.55648] == (219, 106) and near[158.62952] == (219, 107)


def test_limits_are_what_a_search_finds(spark):
    for r in bayes.limit_table(spark, 3, 40, 5).where("k < 40").collect():
        assert (r["n_peak"], r["n_eclipse"]) == (bayes.least_peak(r["mu"], bayes.threshold("peak", 3)), bayes.greatest_eclipse(r["mu"], bayes.threshold("eclipse", 3)))


@pytest.mark.parametrize("mu", [1e-6, 0.3, 17.0, 63.0, 64.0, 65.0, 500.0, 1e5, 1e6])
def test_constant_work_against_sums(spark, mu):
    """Counts on both sides of what is expected, few and a million, against sums of all terms in logarithms."""
    counts = sorted({max(0, round(mu + d * math.sqrt(mu))) for d in (-40, -7, -1, 0, 1, 7, 40)} | {0, 1, 64, 65, 300})
    n, m = F.col("n"), F.col("mu")
    df = spark.createDataFrame([(k, mu) for k in counts], "n long, mu double")
    for r in df.select("n", bayes.log_peak(n, m).alias("p"), bayes.log_eclipse(n, m).alias("e"), bayes.log_pmf(n, m).alias("l"), gamma.log_factorial(n).alias("f")).collect():
        assert r["p"] == pytest.approx(bayes.log_peak_np(r["n"], mu), rel=1e-9, abs=1e-9)
        assert r["e"] == pytest.approx(bayes.log_eclipse_np(r["n"], mu), rel=1e-9, abs=1e-9)
        assert r["l"] == pytest.approx(r["n"] * math.log(mu) - mu - math.lgamma(r["n"] + 1), rel=1e-9, abs=1e-7)
        assert r["f"] == pytest.approx(math.lgamma(r["n"] + 1), rel=1e-12, abs=1e-12)
