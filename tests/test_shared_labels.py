"""Curves that share a label: the results do not hang on the order in which rows come."""

import pytest

from sparkburst.operators import features

#: (it, n) of two curves under one label.
ROWS = [(0, 4), (1, 0), (2, 3), (3, 0), (0, 0), (1, 4), (2, 0), (3, 1)]


def shared(spark, rows):
    return spark.createDataFrame([("r", 7, it, n) for it, n in rows], "runid string, label long, it long, n long").coalesce(1)


def each_order(spark, made):
    """The rows of ``made`` for the rows as they are, backwards and by turns, which must be the same."""
    found = [sorted(tuple(r) for r in made(shared(spark, rows)).collect()) for rows in (ROWS, ROWS[::-1], sorted(ROWS), sorted(ROWS, key=lambda r: (r[0], -r[1])))]
    assert all(f == found[0] for f in found)
    return found[0]


def test_convolution(spark):
    found = each_order(spark, lambda c: features.convolved(c, [0.5, 0.3, 0.2]).select("it", "convolved"))
    assert [v for _, v in found] == pytest.approx([0.0, 2.0, 1.2, 2.8, 1.2, 2.3, 0.9, 1.1])


def test_crossings(spark):
    assert each_order(spark, lambda c: features.crossings(c, 1)) == [("r", 7, 3.0)]


def test_largest_peak(spark):
    assert each_order(spark, features.largest_peak) == [("r", 7, 0, 4, True, False, True)]


def test_local_maxima(spark):
    assert each_order(spark, lambda c: features.local_maxima(c, 2)) == [("r", 7, 3)]
