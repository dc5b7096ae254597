"""Reading inputs and cutting lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with batches for Python of so few rows that long texts fit the workers' memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='sparkburst-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, like: str = "table") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    Later stages start from files that survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{like}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffles_cleared(f: Callable) -> Callable:
    """``f``, whose first argument is a DataFrame: within it, what a query has shuffled is deleted at its end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @functools.wraps(f)
    def run(df: DataFrame, *a, **b):
        conf = df.sparkSession.conf
        before = conf.get(key, None)
        conf.set(key, "true")
        try:
            return f(df, *a, **b)
        finally:
            if before is None:
                conf.unset(key)
            else:
                conf.set(key, before)

    return run
