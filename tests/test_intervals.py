"""Hand-computed cases of interval logic."""

import pytest
from pyspark.sql import functions as F

from sparkburst.operators import intervals


def curve(spark, values):
    return spark.createDataFrame([("o", 100 * i, float(v)) for i, v in enumerate(values)], "obsid string, it long, rate double")


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([0, 2, 2, 0, 0, 0], [(0, 200)]),
        ([2, 0, 0, 2, 0, 0], [(0, 0), (200, 300)]),
        ([0, 0, 2, 0, 0, 2], [(100, 200), (400, 500)]),
        ([2, 0, 0, 0, 0, 2], [(0, 0), (400, 500)]),
        ([2] * 6, [(0, 500)]),
        ([0] * 6, []),
    ],
)
def test_bad_times(spark, values, expected):
    got = intervals.bad_times(curve(spark, values), 1.0).orderBy("start").collect()
    assert [(r["start"], r["stop"]) for r in got] == expected


def test_bad_bins(spark):
    edges = spark.createDataFrame([("o", k, float(100 * k)) for k in range(11)], "obsid string, k long, t double")
    bti = spark.createDataFrame([("o", 300.0, 500.0)], "obsid string, start double, stop double")
    assert [r["k"] for r in intervals.bad_bins(edges, bti).collect()] == [3]


def test_overlap_groups(spark):
    lists = spark.createDataFrame([("o", "a", 0, 10), ("o", "b", 10, 20), ("o", "c", 30, 40)], "obsid string, evt_file string, lo long, hi long")
    got = {r["evt_file"]: r["island"] for r in intervals.overlap_groups(lists).collect()}
    assert got == {"a": 1, "b": 1, "c": 2}


def test_longest_per_instrument(spark):
    rows = [("o", f"f{i}", "EPN" if i < 3 else "EMOS1", 0, 10, i) for i in range(5)]
    lists = spark.createDataFrame(rows, "obsid string, evt_file string, instrument string, lo long, hi long, exposure long")
    got = intervals.longest_per_instrument(intervals.overlap_groups(lists))
    assert sorted(r["evt_file"] for r in got.collect()) == ["f2", "f4"]


def test_time_clusters(spark):
    points = spark.createDataFrame([("k", t) for t in (0, 1, 2, 50, 100, 101, 102, 103)], "k string, t long")
    got = intervals.clusters_in_time(points, "k", "t", 2, 3).orderBy("t_lo").collect()
    assert [(r["t_lo"], r["t_hi"]) for r in got] == [(0, 2), (100, 103)]


def test_high_energy_frames_are_dense(spark):
    events = spark.createDataFrame([("o", 0, 11_000), ("o", 50, 500), ("o", 350, 10_500)], "obsid string, t_us long, pi int")
    got = intervals.high_energy_curve(events, 100).orderBy("it").collect()
    assert [(r["it"], r["n"]) for r in got] == [(0, 1), (1, 0), (2, 0), (3, 1)]
    assert intervals.bad_times(intervals.high_energy_curve(events.where(F.lit(False)), 100), 0.5).count() == 0
