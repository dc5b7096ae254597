"""Queries on the components of images of over a thousand rows agree with their SQL."""

import datetime

import duckdb
import pytest

from sparkburst.plans import registry

NAMES = ["q_components", "q_small_detections", "q_sql_region_curves", "q_region_lightcurves", "q_region_props", "q_regions_by_intensity"]


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def tall(tmp_path_factory):
    """Pixels of ten events among many of one; (0, 1005) and (1, 5) have one number in the SQL, (0, 1500) lies after (1, 20)."""
    bright = {(0, 1005), (0, 1006), (1, 5), (1, 20), (0, 1500), (5, 700)}
    faint = {(x, y * 3) for x in (3, 8) for y in range(30)}
    at = [(x, y) for x, y in sorted(bright) for _ in range(10)] + sorted(faint)
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 9), 3 * (10 * y + x), "click", 50.0) for i, (x, y) in enumerate(at)]
    path = str(tmp_path_factory.mktemp("tall"))
    c = duckdb.connect()
    c.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double)")
    c.executemany("insert into events values (?, ?, ?, ?, ?)", rows)
    c.execute(f"copy events to '{path}/events.parquet'")
    return path, c


@pytest.mark.parametrize("name", NAMES)
def test_agrees(spark, tall, name):
    path, c = tall
    df = registry.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[k]) for k in columns) for r in df.collect())
    result = c.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    theirs = sorted(tuple(plain(r[names.index(k)]) for k in columns) for r in result.fetchall())
    assert ours and ours == theirs
