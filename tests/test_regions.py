"""Components, their counts at every level, and the threshold for a number of them, against plain versions."""

import random

import pytest

from sparkburst.operators import graphs, regions


def labels(pixels):
    """{(obsid, ix, iy): label}."""
    out, count = {}, {}
    for p in sorted(set(pixels)):
        if p not in out:
            label = count[p[0]] = count.get(p[0], -1) + 1
            todo = [p]
            while todo:
                o, x, y = todo.pop()
                if (o, x, y) in out or (o, x, y) not in pixels:
                    continue
                out[o, x, y] = label
                todo += [(o, x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return out


def scattered(seed, share, w=40, h=30):
    r = random.Random(seed)
    return {(o, x - 5, y) for o in ("a", "b") for x in range(w) for y in range(h) if r.random() < share}


@pytest.mark.parametrize("tile", [4, 7, 64])
@pytest.mark.parametrize("share", [0.1, 0.4, 0.6])
def test_components(spark, tile, share):
    pixels = scattered(tile, share)
    df = spark.createDataFrame([(*p, "spare") for p in pixels], "obsid string, ix long, iy long, more string").repartition(5)
    got = regions.components(df.unionByName(df.limit(20)), tile)
    assert got.columns == [*df.columns, "label"]
    rows = got.collect()
    assert len(rows) == len(pixels)
    assert {(r.obsid, r.ix, r.iy): r.label for r in rows} == labels(pixels)


def test_one_image_over_many_tiles(spark):
    """A spiral that winds through all tiles is one component, whatever number of tasks it meets."""
    pixels, x, y, d, seen = set(), 0, 0, (0, 1), set()
    n = 41
    for _ in range(n * n):
        pixels.add(("a", x, y))
        seen.add((x, y))
        ahead = (x + 2 * d[0], y + 2 * d[1])
        if not (0 <= x + d[0] < n and 0 <= y + d[1] < n) or ahead in seen:
            d = (d[1], -d[0])
            if (x + 2 * d[0], y + 2 * d[1]) in seen or not (0 <= x + d[0] < n and 0 <= y + d[1] < n):
                break
        x, y = x + d[0], y + d[1]
    df = spark.createDataFrame(sorted(pixels), "obsid string, ix long, iy long")
    got = regions.components(df, 5)
    assert {(r.obsid, r.ix, r.iy): r.label for r in got.collect()} == labels(pixels) and got.agg({"label": "max"}).first()[0] == 0
    assert "Pandas" not in got._jdf.queryExecution().toString()
    assert regions.components(df.where("false")).count() == 0


def test_gathered_tiles(spark, monkeypatch):
    """Tables end at tiles' ends, however small the batches."""
    import pyarrow as pa

    monkeypatch.setattr(regions, "_GATHERED", 5)
    rows = sorted((o, t) for o in "ab" for t in range(4) for _ in range(random.Random(t).randrange(1, 9)))
    batches = [pa.RecordBatch.from_pydict({"o": [o for o, _ in rows[k : k + 3]], "t": [t for _, t in rows[k : k + 3]]}) for k in range(0, len(rows), 3)]
    tables = list(regions._tiles(iter(batches), 2))
    assert sum(t.num_rows for t in tables) == len(rows) and len(tables) > 2
    ends = [{tuple(r.values()) for r in t.to_pylist()} for t in tables]
    assert sum(map(len, ends)) == len(set().union(*ends))


def counted(values, level):
    return {o: 1 + max([k for (p, _, _), k in labels({q for q, v in values.items() if v > level and q[0] == o}).items()], default=-1) for o in {p[0] for p in values}}


@pytest.mark.parametrize("tile", [4, 64])
def test_counts_at_every_level(spark, tile):
    r = random.Random(tile)
    values = {p: r.choice([r.random() * 10, r.randrange(5)]) for p in scattered(3, 0.7, 14, 12)}
    df = spark.createDataFrame([(*p, float(v)) for p, v in values.items()], "obsid string, ix long, iy long, v double").repartition(3)
    got = {(x.obsid, x.level): x.n_regions for x in regions.region_counts(df, "v", tile).collect()}
    assert set(got) == {(p[0], float(v)) for p, v in values.items()}
    for level in sorted({v for v in values.values()})[::3]:
        for o, n in counted(values, level).items():
            if (o, float(level)) in got:
                assert got[o, float(level)] == n
    for target in (1, 5, 1000):
        best = {x.obsid: x for x in regions.optimised_sigma(df, "v", target, tile=tile).collect()}
        for o in "ab":
            own = [v for p, v in values.items() if p[0] == o]
            m = sum(own) / len(own)
            s = (sum((v - m) ** 2 for v in own) / len(own)) ** 0.5
            tried = [(abs(counted(values, t)[o] - target), t) for t in sorted({m + 0.1 * s, *(v for v in own if m + 0.1 * s < v <= m + 20 * s)})]
            distance, level = min(tried)
            assert abs(best[o].n_regions - target) == distance and best[o].level == pytest.approx(level) and best[o].sigma == pytest.approx((level - m) / s)


def test_forest(spark):
    r = random.Random(1)
    edges = [(a, b, r.randrange(6)) for a in range(30) for b in range(a + 1, 30) if r.random() < 0.15]
    got = graphs.heaviest_forest(spark.createDataFrame(edges, "a long, b long, w long")).collect()
    parent = list(range(30))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    want = []
    for a, b, w in sorted(edges, key=lambda e: -e[2]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.append(w)
    assert sorted(x.w for x in got) == sorted(want)
