"""Positions that many rows share, and joins of sides that grow with the input."""

import random

from sparkburst.operators import crossmatch
from sparkburst.plans import catalogue_queries



def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sky(spark, seed=3, n=60):
    """Rows of a few positions, some of them close to each other."""
    r = random.Random(seed)
    places = [(10.0 + r.randrange(6) * 8 / 3600, r.randrange(4) * 9 / 3600) for _ in range(12)]
    return spark.createDataFrame([(i, *r.choice(places)) for i in range(n)], "region long, ra_deg double, dec_deg double")


def test_unique_sources_without_broadcast(spark):
    """A broadcast of the regions is built in the driver's memory."""
    found = crossmatch.unique_sources(sky(spark))
    assert "Broadcast" not in plan(found)
    whole = crossmatch.cluster(sky(spark))
    assert sorted(found.collect()) == sorted(whole.drop("members").collect())


def test_cluster_of_copies(spark):
    """Copies give the clusters of their rows: members, means weighted by copies, numbers of chosen regions; no side is broadcast."""
    rows = sky(spark).collect()
    near = {a.region: tuple(b.region for b in rows if abs(a.ra_deg - b.ra_deg) * 3600 < 100 and ((a.ra_deg - b.ra_deg) ** 2 + (a.dec_deg - b.dec_deg) ** 2) ** 0.5 * 3600 <= 20.0) for a in rows}
    found = crossmatch.cluster(sky(spark))
    assert "Broadcast" not in plan(found)
    got = {r.first: r for r in found.collect()}
    assert {first: tuple(r.members) for first, r in got.items()}.items() <= {min(k for k, v in near.items() if v == m): m for m in near.values()}.items()
    assert sum(r.n_chosen for r in got.values()) == len(rows)


def test_within_of_copies(spark):
    """Every row of a position has the pairs of it; rows without a position have none, and no side is broadcast."""
    left = sky(spark).unionByName(spark.createDataFrame([(99, None, 0.0)], "region long, ra_deg double, dec_deg double"))
    right = sky(spark, 4, 30).withColumnRenamed("region", "cat_id")
    found = crossmatch.within(left, right, 20.0)
    assert "Broadcast" not in plan(found)
    a, b = left.where("region < 99").collect(), right.collect()
    want = sorted((x.region, y.cat_id) for x in a for y in b if ((x.ra_deg - y.ra_deg) ** 2 + (x.dec_deg - y.dec_deg) ** 2) ** 0.5 * 3600 <= 20.0)
    assert want and sorted((r.region, r.cat_id) for r in found.collect()) == want


def test_matched_unique_without_broadcast(spark):
    """The regions that pairs are joined with are as many as the input."""
    assert "Broadcast" not in plan(catalogue_queries.q_matched_unique(spark, "/root/testdata/sf0.001"))
