"""What larger tables bring to the queries' views."""

import pytest

from sparkburst.functions import bayes
from sparkburst.plans import cube_queries, run_queries


def test_factors_of_many_counts(spark):
    rows = bayes.factors_at_1000(spark.createDataFrame([(0,), (990,), (12_345,)], "n long")).collect()
    assert [r.n for r in rows] == [0, 990, 12_345]
    for r in rows:
        assert r.b_peak == pytest.approx(bayes.log_peak_np(r.n, 1000.0), abs=1e-6)
        assert r.b_eclipse == pytest.approx(bayes.log_eclipse_np(r.n, 1000.0), abs=1e-6)


def test_observations_of_orders_without_lines(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 8), (3, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(2, None)], "l_orderkey long, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.obsid for r in run_queries.q_observation_ids(spark, str(tmp_path)).collect()) == ["0000000007", "0000000008"]


def test_labels_of_images_of_over_a_thousand_rows(spark):
    """Components are labelled by their least pixel number, which (0, 1005) and (1, 5) share, as in the SQL."""
    rows = [("a", 1, 5, 0), ("a", 1, 6, 0), ("a", 0, 2000, 1), ("a", 0, 1005, 2), ("b", 2, 2, 0)]
    got = cube_queries.as_numbered(spark.createDataFrame(rows, "obsid string, ix long, iy long, label long"))
    assert {(r.obsid, r.ix, r.iy): r.label for r in got.collect()} == {("a", 1, 5): 0, ("a", 1, 6): 0, ("a", 0, 1005): 0, ("a", 0, 2000): 1, ("b", 2, 2): 0}
