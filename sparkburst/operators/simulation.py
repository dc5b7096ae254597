"""Injection of bursts and eclipses into Poisson cubes, and how often they are found again.

Every cell draws from a generator seeded by its own key, so draws do not depend on
how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.bayes import PEAK_3, log_peak


@F.pandas_udf(LongType())
def poisson_draw(seed: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series([int(np.random.default_rng(abs(int(s))).poisson(max(m, 0.0))) for s, m in zip(seed, mean, strict=True)])


def burst_profile(dx: Column, dy: Column, dt: Column, amplitude: Column, width: Column, psf: float = 0.33) -> Column:
    """Expected counts of a burst in a cell: Gaussian in time and in space (in cells)."""
    space = F.exp(-(dx * dx + dy * dy) / (2 * psf * psf)) / (2 * np.pi * psf * psf)
    time = F.exp(-(dt * dt) / (2 * width * width)) / (np.sqrt(2 * np.pi) * width)
    return amplitude * F.least(space, F.lit(1.0)) * time


def eclipse_profile(dt: Column, depth: Column, width: Column) -> Column:
    """Factor on the expected counts during a dip."""
    return 1 - depth * F.exp(-(dt * dt) / (2 * width * width))


def cube_over(backgrounds: DataFrame, amplitudes: Sequence[float], draws: int, size: int = 5, frames: int = 20, width: float = 1.0, seed: int = 1) -> DataFrame:
    """(.., amplitude, draw, ix, iy, it, mean, n): a burst in the middle of each flat background (.., background)."""
    grid = backgrounds.withColumn("amplitude", F.explode(F.array(*[F.lit(float(a)) for a in amplitudes]))).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    cells = grid.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    mid = size // 2
    burst = burst_profile(F.col("ix") - mid, F.col("iy") - mid, F.col("it") - frames // 2, F.col("amplitude"), F.lit(width))
    drawn = cells.withColumn("mean", F.col("background") + burst)
    return drawn.withColumn("n", poisson_draw(F.xxhash64(F.lit(seed), *[c for c in backgrounds.columns], "amplitude", "draw", "ix", "iy", "it"), "mean"))


def recovery_over(backgrounds: DataFrame, amplitudes: Sequence[float], draws: int, limit: float = PEAK_3, **shape) -> DataFrame:
    """(.., amplitude, caught): for each background the share of draws in which a cell passes the peak threshold."""
    hit = cube_over(backgrounds, amplitudes, draws, **shape).withColumn("b", log_peak(F.col("n"), F.col("background")))
    keys = [*backgrounds.columns, "amplitude"]
    return hit.groupBy(*keys, "draw").agg(F.max("b").alias("b")).groupBy(*keys).agg(F.avg((F.col("b") > limit).cast("double")).alias("caught"))


def _flat(spark: SparkSession, background: float) -> DataFrame:
    return spark.createDataFrame([(float(background),)], "background double")


def cube(spark: SparkSession, amplitudes: Sequence[float], background: float, draws: int, **shape) -> DataFrame:
    return cube_over(_flat(spark, background), amplitudes, draws, **shape).drop("background")


def recovery(spark: SparkSession, amplitudes: Sequence[float], background: float, draws: int, limit: float = PEAK_3, **shape) -> DataFrame:
    return recovery_over(_flat(spark, background), amplitudes, draws, limit, **shape).drop("background")


def envelope(means: DataFrame, shares: Sequence[float] = (0.0013, 0.1587, 0.5, 0.8413, 0.9987)) -> DataFrame:
    """Poisson quantiles (mean, share, n) of each ``mean``, exactly, where the reference values would be drawn."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for mu in pdf["mean"]:
                k = np.arange(0, int(mu + 20 + 12 * np.sqrt(mu + 1)))
                logs = -mu + k * np.log(mu) - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, len(k))))))
                cdf = np.cumsum(np.exp(logs))
                rows += [(mu, q, int(np.searchsorted(cdf, q))) for q in shares]
            yield pd.DataFrame(rows, columns=["mean", "share", "n"])

    return means.select(F.col("mean").cast("double").alias("mean")).where("mean > 0").distinct().mapInPandas(fill, "mean double, share double, n long")
