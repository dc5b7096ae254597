"""Summary tables over regions, matches and object types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_fractions(matches: DataFrame) -> DataFrame:
    """Share of each group's regions that have a match in each group, as a matrix."""
    return matches.groupBy("k1").pivot("k2").agg(F.round(F.avg((F.col("match") > -1).cast("double")), 9))


def frequent(df: DataFrame, column: str, least: int) -> DataFrame:
    """Values of a column that more than ``least`` rows have."""
    return df.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") > least)


def row_range(df: DataFrame, order: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Rows lo to hi - 1 in an order: each task keeps its first ``hi`` rows."""
    return df.orderBy(*order).limit(hi).offset(lo)


def scrubbed(df: DataFrame, columns: Sequence[str], drop: bool = False) -> DataFrame:
    """Infinities and not-a-numbers become null; with ``drop`` the rows that hold a null go."""
    for c in columns:
        x = F.col(c).cast("double")
        df = df.withColumn(c, F.when(F.isnan(x) | F.abs(x).isin(float("inf")), None).otherwise(F.col(c)))
    return df.na.drop(subset=list(columns)) if drop else df


def shapes(tables: dict[str, DataFrame], equal: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(name, n_rows, n_columns, consistent) of a result's tables; those of one group of ``equal`` have to have as many rows as its first."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        rows = one if rows is None else rows.unionByName(one)
    group = F.lit(None).cast("string")
    for names in equal:
        group = F.when(F.col("name").isin(*names), F.lit(names[0])).otherwise(group)
    grouped = rows.withColumn("_g", F.coalesce(group, F.col("name")))
    first = grouped.where(F.col("name") == F.col("_g")).select("_g", F.col("n_rows").alias("_want"))
    return grouped.join(first, "_g").select("name", "n_rows", "n_columns", (F.col("n_rows") == F.col("_want")).alias("consistent"))


def run_statistics(tagged: DataFrame) -> DataFrame:
    per_obs = tagged.groupBy("key", "obsid").agg(F.count("*").alias("c"))
    runs = tagged.groupBy("key").agg(F.count("*").alias("n_regions"), F.countDistinct("runid").alias("n_runs"))
    return runs.join(per_obs.groupBy("key").agg(F.round(F.avg("c"), 9).alias("mean_c"), F.round(F.stddev_samp("c"), 9).alias("std_c")), "key")


def otype_counts(df: DataFrame, total: int) -> DataFrame:
    """Number and percentage of each type of an external total, and what the types leave of it."""
    counts = df.groupBy("otype").agg(F.count("*").alias("n"))
    known = counts.agg((F.lit(total).cast("long") - F.coalesce(F.sum("n"), F.lit(0))).alias("n")).select(F.lit("NO MATCH").alias("otype"), "n")
    return counts.unionByName(known).withColumn("pct", F.round(100.0 * F.col("n") / total, 6))


def otype_pivot(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy("subtype").pivot("otype", list(keys)).agg(F.sum("count")).na.fill(0)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by two columns with margins; a null key is a margin."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("margin"))


def partition_counts(df: DataFrame, peak: Column, eclipse: Column) -> DataFrame:
    return df.groupBy(peak.alias("is_peak"), eclipse.alias("is_eclipse")).agg(F.count("*").alias("n"))


def threshold_sweep(df: DataFrame, column: str, grid: Sequence[float]) -> DataFrame:
    """Rows over each threshold: values are ranked on the grid once, then cumulated over its few cells."""
    at = F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: F.col(column) > g))
    cells = df.groupBy(at.alias("k")).agg(F.count("*").alias("c"))
    points = df.sparkSession.createDataFrame([(i, float(g)) for i, g in enumerate(grid)], "i int, threshold double")
    return points.join(F.broadcast(cells), F.col("k") > F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("c"), F.lit(0).cast("long")).alias("n_over"))


def by_type(df: DataFrame, least: int) -> DataFrame:
    """Separations by object type, for types of at least ``least`` rows."""
    return df.groupBy("otype").agg(
        F.count("*").alias("n"), F.round(F.avg("sep"), 6).alias("mean_sep"), F.round(F.stddev_samp("sep"), 6).alias("std_sep"), F.round(F.percentile("sep", F.lit(0.16)), 6).alias("q16"), F.round(F.percentile("sep", F.lit(0.84)), 6).alias("q84")
    ).where(F.col("n") >= least)
