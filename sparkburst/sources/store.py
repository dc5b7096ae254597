"""Tables of runs: written per run, read back and united."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bayes import limit_table
from ..operators.catalogues import as_columns, as_rows, described


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/sparkburst"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def kept(make: Callable[[], DataFrame], spark: SparkSession, path: str, anew: bool = False) -> DataFrame:
    """A stored result, made and written only if it is not there yet, or if it is asked for anew."""
    if anew or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def limits(spark: SparkSession, root: str, sigma: float = 3) -> DataFrame:
    """The limit table of a significance, computed once for a store."""
    return kept(lambda: limit_table(spark, sigma), spark, f"{root}/limits_{sigma:g}")


#: The tables that a run leaves.
TABLES = ("alerts", "regions", "light_curves", "run_info", "obs_info", "evt_info", "cube_info", "bti")


def save(df: DataFrame, root: str, table: str, runid: str | None = None, mode: str = "errorifexists") -> None:
    """Writes a table, an empty one too; with ``runid`` it is stamped and becomes that run's part."""
    if runid is not None:
        df = df.withColumn("runid", F.lit(runid))
    if "runid" in df.columns and runid is not None:
        df.write.mode(mode).parquet(f"{root}/{table}/run={runid}")
    else:
        df.write.mode(mode).parquet(f"{root}/{table}")


def load(spark: SparkSession, root: str, table: str, runid: str | None = None) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{root}/{table}/run={runid}" if runid else f"{root}/{table}")


def load_run(spark: SparkSession, root: str, runid: str) -> dict[str, DataFrame]:
    """All tables of one run from a store of many: the filter is pushed to the scans.

    Tables of an observation and of a frame length give their rows for the run's.
    """
    obsid, _, t_bin, *_ = runid.split("_")
    of = {"bti": ("timed", f"{obsid}_{t_bin}"), "evt_info": ("runid", obsid), "obs_info": ("runid", obsid)}
    out = {}
    for table in TABLES:
        if exists(spark, f"{root}/{table}"):
            column, value = of.get(table, ("runid", runid))
            out[table] = load(spark, root, table).where(F.col(column) == value)
    return out


def save_info(df: DataFrame, root: str, table: str, key: str = "runid") -> None:
    """Scalars as key-value rows."""
    save(as_rows(df, key), root, table)


def load_info(spark: SparkSession, root: str, table: str, names: list[str], key: str = "runid") -> DataFrame:
    return as_columns(load(spark, root, table), key, names)


def combine(spark: SparkSession, root: str, target: str, tables: tuple[str, ...] = TABLES) -> dict[str, int]:
    """Unites all runs' parts of each table that exists; refuses to overwrite.  Returns the number of rows by table."""
    out = {}
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for t in tables:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{t}")):
            united = load(spark, root, t).drop("run")
            order = [c for c in ("runid", "label") if c in united.columns]
            united = united.repartitionByRange(*order).sortWithinPartitions(*order) if order else united
            united.write.mode("errorifexists").parquet(f"{target}/{t}")
            out[t] = spark.read.parquet(f"{target}/{t}").count()
    return out


def light_curve(spark: SparkSession, target: str, runid: str, label: int) -> DataFrame:
    """One light curve: the filter is pushed to files that are sorted by run and label."""
    return spark.read.parquet(f"{target}/light_curves").where((F.col("runid") == runid) & (F.col("label") == label)).orderBy("it")


def save_catalogue(df: DataFrame, path: str) -> None:
    """A catalogue whose columns carry units and descriptions as metadata."""
    described(df).write.mode("errorifexists").parquet(path)


def observation_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("obsid")).where("obsid <> ''")
