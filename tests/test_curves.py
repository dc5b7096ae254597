"""Light curves whose sums need no window over an observation."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkburst.operators import cube, features
from sparkburst.plans import curve_queries

DATA = "/root/testdata/sf0.001"


def windows(df):
    """The plan's windows over observations, whose rows one task would hold."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x and "obsid#" in x]


def test_dense_expected(spark):
    rows = [("a", 0, 0, 3, 2), ("a", 0, 0, 6, 1), ("a", 70, -3, 4, 5), ("b", 1, 1, 9, 4)]
    cells = spark.createDataFrame(rows, "obsid string, ix long, iy long, it long, n long")
    d = cube.dense(cells)
    total = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    want = d.withColumn("mu", total("obsid", "ix", "iy") * total("obsid", "it") / total("obsid"))
    assert d.count() == 9 and sorted(cube.dense_expected(cells).collect()) == sorted(want.collect())


def test_curves_without_windows(spark):
    assert not windows(curve_queries.q_curve_moments(spark, DATA))


def test_ks_of_counted_values(spark):
    """Equal values are one row of the window."""
    c = spark.createDataFrame([("r", 0, i, float(i % 3), float(i % 2)) for i in range(60)], "runid string, label long, it long, n double, mu double")
    found = features.ks_statistic(c)
    assert "sum(_a" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first()["ks"] == pytest.approx(1 / 3) and found.first()["len"] == 60


def test_q_ks_statistic_without_observation_windows(spark):
    assert not windows(curve_queries.q_ks_statistic(spark, DATA))


def test_q_paired_t_without_observation_windows(spark):
    assert not windows(curve_queries.q_paired_t(spark, DATA))


def test_q_sig_bins_without_observation_windows(spark):
    assert not windows(curve_queries.q_sig_bins(spark, DATA))


def test_q_lc_shift_without_observation_windows(spark):
    assert not windows(curve_queries.q_lc_shift(spark, DATA))
