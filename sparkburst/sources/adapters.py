"""Domain views on generic input tables.

Operators see the domain schema only; these functions name its columns.  Times
are whole microseconds since the epoch of the mission, so that binning is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01 in microseconds since 1970.
EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ix, iy = F.expr("(user_id div 3) % 10"), F.expr("user_id div 30")
    instrument = F.when(F.col("event_type").isin("click", "purchase"), "EPN").when(F.col("event_type").isin("view", "error"), "EMOS1").otherwise("EMOS2")
    return e.select(
        "event_id",
        F.lpad((F.col("user_id") % 3).cast("string"), 10, "0").alias("obsid"),
        instrument.alias("instrument"),
        (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).alias("t_us"),
        ix.alias("ix"),
        iy.alias("iy"),
        (ix * 400 + F.col("event_id") % 400).cast("double").alias("x"),
        (iy * 400 + (F.col("event_id") * 7) % 400).cast("double").alias("y"),
        ((F.col("event_id") * 7) % 64).alias("rawx"),
        ((F.col("event_id") * 13) % 200).alias("rawy"),
        (F.col("user_id") % 12 + 1).alias("ccdnr"),
        F.floor(F.col("value") * 100).cast("int").alias("pi"),
        (F.col("event_id") % 14).alias("pattern"),
    )


def photons_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger view of the same shape: one photon per order line."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat("l_returnflag", "l_linestatus").alias("obsid"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("t_us"),
        (F.col("l_suppkey") % 16).alias("ix"),
        (F.col("l_partkey") % 16).alias("iy"),
        (F.col("l_quantity") * 240).cast("int").alias("pi"),
    )


def hot_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 4 = 0")
    return p.select(
        (F.col("p_partkey") % 64).alias("rawx"), ((F.col("p_partkey") * 3) % 200).alias("rawy"), (F.col("p_partkey") % 12 + 1).alias("ccdnr"),
        (F.col("p_size") % 20).cast("long").alias("rev1"), (F.col("p_size") % 20 + 25).cast("long").alias("rev2"),
    )


def event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event list per order: the days of its lines."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    days = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400000000")
    spans = line.groupBy("l_orderkey").agg(F.min(days).alias("lo"), F.max(days).alias("hi"))
    kinds = F.element_at(F.array(*map(F.lit, ("EPN", "EMOS1", "EMOS2"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    modes = F.element_at(F.array(*map(F.lit, ("PrimeFullWindow", "PrimeLargeWindow", "FastTiming", "PrimeFullWindowExtended"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.join(spans, o.o_orderkey == spans.l_orderkey).select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("obsid"), F.concat(F.lit("P"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("evt_file"),
        kinds.alias("instrument"), modes.alias("submode"), (F.col("o_orderkey") % 60).alias("revolution"), F.floor("o_totalprice").cast("long").alias("exposure"), "lo", "hi",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation of every order, whether it has lines or not."""
    return table(spark, sf_dir, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("obsid"))


def _sky(df: DataFrame, key: str) -> DataFrame:
    """Golden-ratio positions: pairs of neighbours in key land close to each other."""
    pair = F.floor(F.col(key) / 2).cast("long")
    turn = (pair * 61803) % 100000
    return df.withColumn("ra_deg", turn * 0.0036 + (F.col(key) % 2) * 0.001).withColumn("dec_deg", ((pair * 38197) % 100000) * 0.0016 - 80.0 + (F.col(key) % 2) * 0.002)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detected region per customer."""
    c = table(spark, sf_dir, "customer")
    t_bin = F.element_at(F.array(*map(F.lit, (5, 50, 200))), (F.col("c_custkey") % 3 + 1).cast("int"))
    band = F.element_at(F.array(*map(F.lit, ("0.2_2.0", "2.0_12.0", "0.2_12.0"))), (F.floor(F.col("c_custkey") / 3) % 3 + 1).cast("int"))
    obsid = F.lpad((F.col("c_nationkey") * 10 + F.col("c_custkey") % 10).cast("string"), 10, "0")
    out = c.select(
        F.col("c_custkey").alias("region"), obsid.alias("obsid"), t_bin.alias("t_bin"), F.concat_ws("_", obsid, F.lit("0"), t_bin.cast("string"), band).alias("runid"),
        (F.col("c_custkey") % 7).alias("label"), F.floor(F.abs("c_acctbal")).cast("long").alias("intensity"), (F.col("c_custkey") % 30 + 1).alias("area_bbox"),
        ((F.col("c_custkey") * 37) % 1000).alias("x_img"), ((F.col("c_custkey") * 53) % 1000).alias("y_img"), F.col("c_mktsegment").alias("segment"),
    )
    return _sky(out, "region").withColumn("detid", F.concat_ws("_", "runid", F.col("label").cast("string")))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external catalogue: suppliers, beside the positions of every fifth region."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cat_id"), F.floor(F.abs("s_acctbal")).cast("long").alias("flux"), (F.col("s_suppkey") % 2 == 0).alias("var_flag"))
    near = _sky(s.withColumn("k", F.col("cat_id") * 10), "k").drop("k")
    return near.withColumn("ra_deg", F.col("ra_deg") + 0.0005).withColumn("dec_deg", F.col("dec_deg") + (F.col("cat_id") % 5) * 0.002)


def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sources of each observation's source list, with likelihood, extent in arcseconds and total rate."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    extent = F.when(k % 5 == 0, (k % 7) * 4.0).otherwise(0.0)
    return s.select(k.alias("source"), F.lpad((k % 3).cast("string"), 10, "0").alias("obsid"), (k % 20).cast("double").alias("det_ml"), extent.alias("extent"), (F.abs("s_acctbal").cast("double") / 4000).alias("total_rate"), (150.0 + ((k * 37) % 100 - 50) * 0.004).alias("ra_deg"), (20.0 + ((k * 53) % 100 - 50) * 0.004).alias("dec_deg"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header cards of each observation's image, as text."""
    n = table(spark, sf_dir, "nation").where("n_nationkey < 3")
    cards = {"REFXCRVL": F.col("n_nationkey") * 0.01 + 150.0, "REFYCRVL": 20.0 - F.col("n_nationkey") * 0.01, "REFXCRPX": F.lit(25921.0), "REFYCRPX": F.lit(25921.0), "REFXCDLT": F.lit(-1.388888888888889e-05), "REFYCDLT": F.lit(1.388888888888889e-05), "REFXLMAX": F.lit(51840), "REFYLMAX": F.lit(51840)}
    entries = [x for name, value in cards.items() for x in (F.lit(name), value.cast("string"))]
    return n.select(F.lpad(F.col("n_nationkey").cast("string"), 10, "0").alias("obsid"), F.create_map(*entries).alias("header"))


def pointings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointing angle in degrees of some observations."""
    n = table(spark, sf_dir, "nation")
    return n.where("n_nationkey % 4 <> 3").select(F.lpad((F.col("n_nationkey") * 10).cast("string"), 10, "0").alias("obsid"), (F.col("n_nationkey") * 14.5).alias("angle"))


def otypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("otype"), F.col("p_brand").alias("subtype"), F.col("p_size").cast("long").alias("count"), F.col("p_partkey").alias("id"))
