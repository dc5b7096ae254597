"""Regions, features, joins, filters and sources on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkburst.functions import bayes, geometry
from sparkburst.operators import background, catalogues, cleaning, crossmatch, cube, features, filters, ranks, regions, simulation
from sparkburst.plans.pipeline import TransientPipeline
from sparkburst.sources import fits, store
from sparkburst.streaming import live


def test_components(spark):
    px = spark.createDataFrame([("o", 0, 0, 1), ("o", 1, 1, 3), ("o", 3, 0, 1), ("o", 3, 1, 1)], "obsid string, ix long, iy long, total long")
    got = regions.properties(regions.components(px)).orderBy("label").collect()
    assert len(got) == 2
    assert [got[0][f"bbox_{k}"] for k in range(4)] == [0, 0, 2, 2]
    assert got[0]["area_bbox"] == 4 and got[0]["equivalent_diameter"] == pytest.approx(1.5957691, abs=1e-6)
    assert regions.by_intensity(regions.properties(regions.components(px))).count() == 2


def curve(spark, values, mu=1.0):
    return spark.createDataFrame([("r", 0, i, v, mu, False) for i, v in enumerate(values)], "runid string, label long, it long, n long, mu double, bti boolean")


def test_features(spark):
    assert features.local_maxima(curve(spark, [0, 3, 3, 0, 5, 1, 7]), 2).first()["n_maxima"] == 2
    assert features.distant_peaks(curve(spark, [0, 1, 0, 0, 1, 1, 0, 1]), 0, 2).first()["n_distant"] == 2
    assert features.distant_peaks(curve(spark, [0, 0]), 0, 2).first()["n_distant"] == 0
    top = features.largest_peak(curve(spark, [0, 0, 5, 0])).first()
    assert (top["idx"], top["isolated"], top["is_first"], top["is_last"]) == (2, True, False, False)
    top = features.largest_peak(curve(spark, [0, 5])).first()
    assert (top["idx"], top["is_last"]) == (1, True)
    ks = spark.createDataFrame([("r", 0, i, float(n), float(m)) for i, (n, m) in enumerate([(1, 2), (2, 3), (3, 4)])], "runid string, label long, it long, n double, mu double")
    assert features.ks_statistic(ks).first()["ks"] == pytest.approx(1 / 3)
    m = features.moments(curve(spark, [0, 1, 2, 5])).first()
    assert m["std_n"] == pytest.approx(2.1602469, abs=1e-6) and m["skew_n"] == pytest.approx(0.6872432, abs=1e-6) and m["kurt_n"] == pytest.approx(-1.0, abs=1e-6)


def test_cluster_is_not_transitive(spark):
    sky = spark.createDataFrame([(0, 10.0, 0.0), (1, 10.0, 10 / 3600), (2, 10.0, 25 / 3600)], "region long, ra_deg double, dec_deg double")
    got = crossmatch.numbered(crossmatch.cluster(sky, 20.0)).orderBy("cluster_label").collect()
    assert [r["members"] for r in got] == [[0, 1], [0, 1, 2], [1, 2]]


@pytest.mark.parametrize("dec", [0.0, 60.0, 89.99, -90.0])
def test_within_against_all_pairs(spark, dec):
    rng = np.random.default_rng(5)
    a = [(i, float((359.99 + rng.uniform(0, 0.03)) % 360), float(np.clip(dec + rng.uniform(-0.02, 0.02), -90, 90))) for i in range(60)]
    left = spark.createDataFrame(a, "region long, ra_deg double, dec_deg double")
    right = left.withColumnRenamed("region", "cat_id")
    got = {(r["region"], r["cat_id"]) for r in crossmatch.within(left, right, 30.0).collect()}
    sep = geometry.separation(F.col("a.ra_deg"), F.col("a.dec_deg"), F.col("b.ra_deg"), F.col("b.dec_deg"))
    every = left.alias("a").join(right.alias("b"), F.round(sep, 6) <= 30.0).select("region", "cat_id").collect()
    assert got == {(r["region"], r["cat_id"]) for r in every}


def test_nearest_has_no_bound(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 180.0, -45.0)], "region long, ra_deg double, dec_deg double")
    right = spark.createDataFrame([(7, 90.0, 80.0)], "cat_id long, ra_deg double, dec_deg double")
    got = crossmatch.nearest(left, right).collect()
    assert sorted(r["region"] for r in got) == [1, 2] and all(r["cat_id"] == 7 for r in got)


def test_sky_round_trip(spark):
    df = spark.createDataFrame([(float(i), float(j)) for i in range(5) for j in range(5)], "px double, py double")
    wcs = ((2.0, 2.0), (-0.01, 0.01), (150.0, 20.0))
    ra, dec = geometry.pixel_to_sky(F.col("px"), F.col("py"), *wcs)
    back = df.withColumn("ra", ra).withColumn("dec", dec)
    x, y = geometry.sky_to_pixel(F.col("ra"), F.col("dec"), *wcs)
    assert back.where((F.abs(x - F.col("px")) > 1e-8) | (F.abs(y - F.col("py")) > 1e-8)).count() == 0
    ra2, dec2 = geometry.offset_by(F.lit(150.0), F.lit(0.0), 90.0, F.lit(1.0))
    assert df.select(F.round(ra2, 9).alias("a"), F.round(dec2, 9).alias("b")).first()[:] == (151.0, 0.0)


def test_lattice(spark):
    df = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 1, 11)], "e long, t long, cluster_label long")
    cats = [[filters.above("e", 1), filters.above("e", 2)], [filters.below("t", 2), filters.below("t", 3)]]
    assert len(filters.combinations(cats)) == 9
    got = {r["node"]: (r["n_reg"], r["n_unique"]) for r in filters.lattice(df, cats).collect()}
    for node, chosen in enumerate(filters.combinations(cats)):
        kept = filters.apply(df, *chosen)
        expected = (kept.count(), kept.select("cluster_label").distinct().count())
        assert got.get(node, (0, 0)) == expected
    with pytest.raises(ValueError):
        filters.separated("x", 1, "sideways")


def test_null_comparisons_do_not_pass(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "x double")
    assert filters.info(df, filters.above("x", 1)).first()["n_removed"] == 1


def test_hot_pixels_keep_repeats(spark):
    e = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 1, 5), (1, 1, 1, 10), (2, 1, 1, 5)], "rawx long, rawy long, ccdnr long, revolution long")
    hot = spark.createDataFrame([(2, 1, 1, 0, 9), (1, 1, 1, 5, 20)], "rawx long, rawy long, ccdnr long, rev1 long, rev2 long")
    assert cleaning.without_hot_pixels(e, hot).count() == 2
    assert cleaning.without_hot_pixels(e, hot.where("false")).count() == 4


def test_histogram_edges(spark):
    e = spark.createDataFrame([("o", x, 0.0, 0) for x in (0.0, 9.99, 10.0, 20.0, 20.01, -0.1)], "obsid string, x double, y double, t_us long")
    got = {r["ix"]: r["n"] for r in cube.binned_xyt(e, (0.0, 20.0, 2), (0.0, 1.0, 1), (0, 1, 1)).collect()}
    assert got == {0: 2, 1: 2}


def test_background_fill(spark):
    image = spark.createDataFrame([("o", i, j, 5 + (i * 7 + j) % 3) for i in range(6) for j in range(6)], "obsid string, ix long, iy long, total long")
    mask = image.where("ix = 2 and iy = 2").select("obsid", "ix", "iy")
    t = background.background_template(image, mask, sigma=0.1)
    rows = {(r["ix"], r["iy"]): r["template"] for r in t.collect()}
    outside = image.where("not (ix = 2 and iy = 2)").agg(F.sum("total")).first()[0]
    assert rows[0, 0] == pytest.approx(5 / outside)
    assert 5 / outside <= rows[2, 2] <= 7 / outside


def test_injection(spark):
    got = {r["amplitude"]: r["caught"] for r in simulation.recovery(spark, (1, 100), 0.2, 10).collect()}
    assert got[100.0] == 1.0 and got[1.0] < 0.5
    a = simulation.cube(spark, (5,), 0.2, 2).agg(F.sum("n")).first()[0]
    assert a == simulation.cube(spark, (5,), 0.2, 2).repartition(7).agg(F.sum("n")).first()[0]


def test_pipeline(spark):
    rows = [("o", i % 4, i // 4 % 4, (i * 79190007) % 30_000_000_000, 1000) for i in range(400)] + [("o", 1, 1, 900_000_000 + i, 1000) for i in range(60)]
    rows += [("o", x, 3, t * 1_000_000 + i, 5000) for x in range(4) for t in range(0, 30_000, 100) if x < 3 or not 12_000 <= t < 15_000 for i in range(12)]  # bright, one with a dip
    rows += [("o", 2, 0, 20_000_000_000 + k * 100_000_000 + i, 11_000) for k in range(24) for i in range(150)]  # a hard flare of 2,400 seconds, in bins of 100
    events = spark.createDataFrame([(*r, k % 12 + 1) for k, r in enumerate(rows)], "obsid string, ix long, iy long, t_us long, pi int, ccdnr int")
    p = TransientPipeline(events, bayes.limit_table(spark, 3, 2000, 20).cache(), time_bins=(600,), bands=((0.2, 12.0),), whole_frames_only=False, hard_rate=0.5)
    alerts = p.alerts().collect()
    assert any(r["is_peak"] and (r["ix"], r["iy"]) == (1, 1) for r in alerts)
    assert any(r["is_eclipse"] and (r["ix"], r["iy"]) == (3, 3) and r["n"] < 3 for r in alerts)
    assert [(r["start"], r["stop"]) for r in p.bad_times().collect()] == [(19_900_000_000, 22_300_000_000)]
    # frames from the first that begins within the flare up to the one before its last
    assert {r["it"] for r in p.frames().where("is_bti").collect()} == {34, 35, 36}
    held = {r["it"] for r in p.cells().collect()}
    assert not held & {34, 35, 36} and {33, 37} <= held
    found = p.regions().collect()
    assert len(found) >= 1
    box = next(r for r in found if r["bbox_0"] <= 3 < r["bbox_2"] and r["bbox_1"] <= 3 < r["bbox_3"])
    curve = {r["it"]: r for r in p.light_curves().where(F.col("label") == box["label"]).collect()}
    assert set(curve) == {r["it"] for r in p.frames().where("kept").collect()}
    cells = p.cells().where((F.col("ix") >= box["bbox_0"]) & (F.col("ix") < box["bbox_2"]) & (F.col("iy") >= box["bbox_1"]) & (F.col("iy") < box["bbox_3"]))
    assert sum(r["n"] for r in curve.values()) == cells.agg(F.sum("n")).first()[0]
    # the curve's expectation is that of the box's pixels, and scored cells have theirs
    model = {(r["ix"], r["iy"]): r for r in p.model().collect()}
    frames = {r["it"]: r for r in p.background_curve().collect()}
    expected = lambda x, y, t: model[x, y]["template"] * frames[t]["outside"] + model[x, y]["rate"] * frames[t]["exposure"]
    inside = [(x, y) for x, y in model if box["bbox_0"] <= x < box["bbox_2"] and box["bbox_1"] <= y < box["bbox_3"]]
    assert all(curve[t]["mu"] == pytest.approx(sum(expected(x, y, t) for x, y in inside) if t in frames else 0.0) for t in curve)
    scored = p.scored().collect()
    assert all(r["mu"] == pytest.approx(expected(r["ix"], r["iy"], r["it"])) for r in scored)
    least = np.log1p(10 ** bayes.threshold("eclipse", 3.0)) - 0.1
    empty = {(x, y, t) for x, y in model for t in frames if expected(x, y, t) > least} - {(r["ix"], r["iy"], r["it"]) for r in p.cells().collect()}
    assert {(r["ix"], r["iy"], r["it"]) for r in scored if r["n"] == 0} == empty and empty


def test_pipeline_tables(spark, tmp_path):
    """Known sources keep their rate, both kinds of time their templates; all tables are stored and loaded."""
    r = random.Random(5)
    rows = [("o", x, y, r.randrange(60_000_000_000), 1000) for x in range(8) for y in range(8) for _ in range(60)]
    rows += [("o", 3, 3, r.randrange(60_000_000_000), 1000) for _ in range(2000)]
    rows += [("o", r.randrange(4), r.randrange(8), 30_000_000_000 + k * 100_000_000 + i, 11_000) for k in range(100) for i in range(100)]
    rows += [("o", x, 6, 5_000_000_000 + i, 1000) for x in (1, 6) for i in range(60)]  # two bursts
    events = spark.createDataFrame([(*x, k % 12 + 1) for k, x in enumerate(rows)], "obsid string, ix long, iy long, t_us long, pi int, ccdnr int")
    sources = spark.createDataFrame([("o", 3, 3, 0.05), ("other", 1, 1, 5.0)], "obsid string, sx long, sy long, rate double")
    plane = spark.createDataFrame([("o", 4.0, 4.0, -0.005, 0.005, 150.0, 20.0)], "obsid string, crpix_x double, crpix_y double, cdelt_x double, cdelt_y double, crval_x double, crval_y double")
    p = TransientPipeline(events, bayes.limit_table(spark, 3, 2000, 20).cache(), time_bins=(300, 600), bands=((0.2, 12.0),), whole_frames_only=False, good_times_only=False, sources=sources, wcs=plane)
    assert {(x["ix"], x["iy"]) for x in p.source_mask().where("obsid like '%_300_%'").collect()} == {(3, 3)}
    model = {(x["obsid"], x["is_bti"], x["ix"], x["iy"]): x for x in p.model().collect()}
    run = "o_0_300_0.2_12.0"
    assert model[run, False, 3, 3]["rate"] == pytest.approx(2000 / 200, rel=0.25) and model[run, False, 0, 0]["rate"] == 0
    left = lambda bad: sum(model[run, bad, x, y]["template"] for x in range(4) for y in range(8))
    assert left(False) < 0.6 and left(True) > 0.8  # flares light one side, good frames at their ends a little
    info = {x["runid"]: x for x in p.cube_info().collect()}
    assert info[run]["n_gti"] + info[run]["n_bti"] == info[run]["n_frames"] == 200 and info[run]["n_bti"] > 20
    detections = p.catalogue(hot=spark.createDataFrame([("nowhere",)], "detid string"))
    assert len(detections.columns) == 27 and [c for c in detections.columns if c.startswith("lc_")] == [f"lc_{c}" for c in catalogues.CURVE_COLUMNS]
    found = {x["detid"]: x for x in detections.collect()}
    curves = {}
    for x in p.light_curves().collect():
        curves.setdefault(f"{x['runid']}_{x['label']}", []).append(x)
    assert set(found) == set(curves) and len(found) >= 2
    for detid, x in found.items():
        n = [y["n"] for y in curves[detid]]
        assert (x["lc_n_max"], x["lc_n_min"], x["lc_n_sum"]) == (max(n), min(n), sum(n)) and x["lc_ratio_bti"] == pytest.approx(sum(y["is_bti"] for y in curves[detid]) / len(n))
        assert not x["filt_hot_pixel"] and x["srcid"].startswith("J") and 0 <= x["lc_ks_pval"] <= 1
    p.save(str(tmp_path / "all"))
    loaded = store.load_run(spark, str(tmp_path / "all"), run)
    assert set(loaded) == set(store.TABLES) and loaded["run_info"].count() == 1 and loaded["cube_info"].first()["n_frames"] == 200
    assert loaded["light_curves"].count() == p.light_curves().where(F.col("runid") == run).count()
    assert loaded["obs_info"].first()["n_runs"] == 2 and loaded["evt_info"].first()["n_events"] == len(rows) and loaded["bti"].count() >= 1


def test_holes_settle(spark):
    """A filled hole's pixels each are the mean of their neighbours, whatever the hole's size; the blur keeps a flat image flat up to its edges."""
    image = spark.createDataFrame([("o", x, y, float(3 * x + 2 * y)) for x in range(20) for y in range(20)], "obsid string, ix long, iy long, total double")
    hole = [(x, y) for x in range(5, 16) for y in range(4, 12)] + [(0, 0), (19, 19)]
    mask = spark.createDataFrame([("o", *h) for h in hole] + [("o", 50, 50)], "obsid string, ix long, iy long")
    got = {(r["ix"], r["iy"]): r["total"] for r in background.fill_holes(image, mask, "total").collect()}
    assert set(got) == set(hole)
    assert all(got[x, y] == pytest.approx(3 * x + 2 * y, abs=1e-8) for x, y in hole[:-2])  # a plane is its own mean
    assert got[0, 0] == pytest.approx((3 + 2 + 5) / 3)
    flat = background.blurred(image.withColumn("total", F.lit(7.0)), "total", 1.3).collect()
    assert len(flat) == 400 and all(r["total"] == pytest.approx(7.0) for r in flat)


def test_holes_at_once(spark):
    """Holes that a task has gathered are solved together, not by a call of Python each; each has the values of its own equations."""
    rng = random.Random(3)
    image = [("ab"[k % 2], x, y, float(rng.randrange(50))) for k in range(2) for x in range(60) for y in range(60)]
    hidden = [(o, x, y) for o, x, y, _ in image if rng.random() < 0.25]
    of = spark.createDataFrame(image, "obsid string, ix long, iy long, total double")
    filled = background.fill_holes(of, spark.createDataFrame(hidden, "obsid string, ix long, iy long"), "total")
    assert "FlatMapGroupsInPandas" not in filled._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["obsid"], r["ix"], r["iy"]): r["total"] for r in filled.collect()}
    place, value = {h: k for k, h in enumerate(hidden)}, {x[:3]: x[3] for x in image}
    left, right = np.zeros((len(hidden), len(hidden))), np.zeros(len(hidden))
    for (o, x, y), k in place.items():
        for near in ((o, x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (o, x + dx, y + dy) in value):
            left[k, k] += 1
            if near in place:
                left[k, place[near]] -= 1
            else:
                right[k] += value[near]
    want = np.linalg.solve(left, right)
    assert set(got) == set(hidden) and [got[h] for h in hidden] == pytest.approx(list(want), abs=1e-8)


def make_fits(rows):
    dtype = np.dtype([("TIME", ">f8"), ("X", ">i4"), ("PI", ">i2")])
    data = np.array(rows, dtype=dtype).tobytes()
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    text = lambda *cards: "".join(cards + ("END".ljust(80),)).ljust(2880).encode()
    head = text(card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0))
    table = text(
        card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", dtype.itemsize), card("NAXIS2", len(rows)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 3),
        card("TTYPE1", "'TIME'"), card("TFORM1", "'D'"), card("TTYPE2", "'X'"), card("TFORM2", "'J'"), card("TTYPE3", "'PI'"), card("TFORM3", "'I'"), card("OBS_ID", "'0000000007'"),
    )
    return head + table + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def test_fits(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "obsPIEVLI_FILT.fits").write_bytes(make_fits([(1.5, 7, 300), (2.5, 8, 900)]))
    schema = StructType.fromDDL("time double, x long, pi int, obs_id string")
    got = fits.events(spark, str(tmp_path), schema).orderBy("time").collect()
    assert [tuple(r) for r in got] == [(1.5, 7, 300, "0000000007"), (2.5, 8, 900, "0000000007")]
    f = fits.files(spark, str(tmp_path)).first()
    assert (f["instrument"], f["stage"]) == ("EPN", "processed")
    assert fits.headers(spark, str(tmp_path)).first()["header"]["OBS_ID"] == "0000000007"


def test_store(spark, tmp_path):
    root, target = str(tmp_path / "runs"), str(tmp_path / "all")
    a = spark.createDataFrame([(1, 0, 5)], "label long, it long, n long")
    store.save(a, root, "light_curves", "r1")
    store.save(a.where("false").withColumn("extra", F.lit(1)), root, "light_curves", "r2")
    assert store.combine(spark, root, target) == {"light_curves": 1}
    assert store.light_curve(spark, target, "r1", 1).first()["n"] == 5
    with pytest.raises(Exception, match="exist"):
        store.combine(spark, root, target)
    info = spark.createDataFrame([("r1", 3, 2.5)], "runid string, a long, b double")
    store.save_info(info, root, "run_info")
    assert store.load_info(spark, root, "run_info", ["a", "b"]).first()["b"] == "2.5"
    cat = spark.createDataFrame([(1.0, 2.0)], "ra_deg double, dec_deg double")
    store.save_catalogue(cat, str(tmp_path / "cat"))
    assert spark.read.parquet(str(tmp_path / "cat")).schema["ra_deg"].metadata["unit"] == "deg"
    (tmp_path / "ids.txt").write_text(" 01 \n\n02\n")
    assert [r[0] for r in store.observation_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["01", "02"]


def test_unique_catalogue_wraps(spark):
    r = spark.createDataFrame([(0, 359.9, 1.0, 0, 5, 1), (1, 0.1, 1.0, 0, 7, 1)], "region long, ra_deg double, dec_deg double, cluster_label long, intensity long, area_bbox long")
    assert catalogues.unique_catalogue(r).first()["ra_deg"] == pytest.approx(180.0)
    ra = catalogues.unique_catalogue(r, wrap_safe=True).first()["ra_deg"]
    assert min(ra, 360 - ra) == pytest.approx(0.0, abs=1e-6)


def test_streaming_bad_times(spark, tmp_path):
    rows = [("o", i, float(v)) for i, v in enumerate([0, 2, 2, 0, 0, 2, 0])]
    spark.createDataFrame(rows, "obsid string, it long, rate double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("obsid string, it long, rate double").parquet(str(tmp_path / "in"))
    got = live.drained(live.bad_times(stream, 1.0), str(tmp_path / "out"), "append").orderBy("start").collect()
    assert [(r["start"], r["stop"]) for r in got] == [(0, 2), (4, 5)]


def test_submodes_that_nobody_knows(spark):
    lists = spark.createDataFrame([("a", "EPN", "PrimeFullWindow"), ("b", "EMOS1", "PrimePartialW2"), ("c", "EPN", "FastBurst")], "evt_file string, instrument string, submode string")
    assert sorted(r["evt_file"] for r in cleaning.supported_lists(lists).collect()) == ["a", "b"]
    strange = lists.unionByName(spark.createDataFrame([("d", "EMOS2", "Nothing"), ("e", "EPN", None)], lists.schema))
    assert sorted(r["evt_file"] for r in cleaning.unknown_submodes(strange).collect()) == ["d", "e"]
    with pytest.raises(Exception, match="unknown submode"):
        cleaning.supported_lists(strange).collect()
    with pytest.raises(Exception, match="timing mode"):
        cleaning.refuse_timing(spark.createDataFrame([("xTIy",)], "evt_file string")).collect()


def test_stored_results_are_not_made_twice(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.kept(make, spark, str(tmp_path / "r")).count() == 3
    assert len(made) == 1 and store.kept(make, spark, str(tmp_path / "r"), anew=True).count() == 3 and len(made) == 2


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 5 AS v")
    got = sorted((r["k"], r["v"], r["s"]) for r in ranks.summed_before(df, "k", "v", "s").collect())
    total = 0
    for _, v, s in got:
        assert s == total
        total += v


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_ranks_of_a_million_rows(spark, adaptive, ranges):
    """Every rank once, with columns beside the order, under bounds from a small sample."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000
        df = spark.range(0, n, 1, 9).selectExpr("(id * 7919) % 1000000 AS k", "concat('spare ', id) AS spare", "id AS more", "id % 5 AS v")
        got = ranks.summed_before(df, "k", "v", "before", ranges)
        got = ranks.numbered(got, "k", "rank", ranges)
        wrong = got.agg(F.count("*"), F.countDistinct("rank"), F.count_if(F.col("rank") != F.col("k")), F.min("rank"), F.max("rank"), F.max(F.col("before") + F.col("v")), F.sum("v")).first()
        assert tuple(wrong)[:5] == (n, n, 0, 0, n - 1) and wrong[5] == wrong[6] == 2 * n
        running = got.where("k < 1000").orderBy("k").collect()
        assert all(b["before"] == a["before"] + a["v"] for a, b in zip(running, running[1:], strict=False))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_ranks_within_keys(spark):
    df = spark.createDataFrame([(k, (i * 37) % 100 if i else None, f"x{i}") for k in ("a", None, "b") for i in range(100)], "k string, o long, spare string")
    got = ranks.numbered_within(df.where("k is not null"), ["k"], ["o"], "r", 5).collect()
    for k in "ab":
        mine = sorted(((r["o"] is not None, r["o"] or 0), r["r"]) for r in got if r["k"] == k)
        assert [r for _, r in mine] == list(range(100))
    assert ranks.numbered(df.where("false"), "o", "r").count() == 0


def test_images_count_empty_frames(spark):
    rows = [("o", 0, 0, t, n) for t, n in ((0, 3), (1, 1), (5, 2), (9, 4))] + [("o", 1, 0, t, 1) for t in range(10)]
    cells = spark.createDataFrame(rows, "obsid string, ix long, iy long, it long, n long")
    want = cube.dense(cells).groupBy("ix").agg(F.sum("n").alias("t"), F.avg("n").alias("a"), F.median("n").alias("m"), F.stddev_pop("n").alias("s"), F.min("n").alias("l")).orderBy("ix").collect()
    got = cube.images(cells).orderBy("ix").collect()
    for w, g in zip(want, got, strict=True):
        assert (w["t"], w["l"]) == (g["total"], g["min_n"]) and g["mean_n"] == pytest.approx(w["a"]) and g["median_n"] == pytest.approx(w["m"]) and g["std_n"] == pytest.approx(w["s"])
