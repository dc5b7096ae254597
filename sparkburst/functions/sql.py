"""The kernels as functions of SQL text: ``register`` makes them known to a session.

Geometry is SQL itself, which the optimizer sees through.  Factors are Arrow
functions.  ``sky_cells`` and ``box_pixels`` are table functions, so that a radius
join and an extraction of regions are equi-joins in plain SQL:

    SELECT r.region, c.cat_id FROM regions r, LATERAL sky_cells(r.ra_deg, r.dec_deg, 20.0, true) k
    JOIN (SELECT c.*, m.band, m.slot FROM catalogue c, LATERAL sky_cells(c.ra_deg, c.dec_deg, 20.0, false) m) c
      ON c.band = k.band AND c.slot = k.slot
    WHERE separation(r.ra_deg, r.dec_deg, c.ra_deg, c.dec_deg) <= 20.0
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, LongType, StructType

from .bayes import log_eclipse_np, log_peak_np

#: name -> parameters, type and body of the functions that are SQL.
SCALARS = {
    "separation": (
        "ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE", "DOUBLE",
        "degrees(2 * asin(sqrt(least(1.0D, pow(sin(radians(dec2 - dec1) / 2), 2) + cos(radians(dec1)) * cos(radians(dec2)) * pow(sin(radians(ra2 - ra1) / 2), 2))))) * 3600",
    ),
    "ra_offset": ("ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE", "DOUBLE", "(ra1 - ra2) * cos(radians(dec1))"),
    "gaussian_peak_counts": ("mu DOUBLE, sigma DOUBLE", "BIGINT", "CAST(ceil((2 * mu + sigma * sigma + sqrt(8 * mu * sigma * sigma + pow(sigma, 4))) / 2) AS BIGINT)"),
    "gaussian_eclipse_counts": ("mu DOUBLE, sigma DOUBLE", "BIGINT", "CAST(floor((2 * mu + sigma * sigma - sqrt(8 * mu * sigma * sigma + pow(sigma, 4))) / 2) AS BIGINT)"),
}


def _longs(*names: str) -> StructType:
    out = StructType()
    for n in names:
        out = out.add(n, LongType())
    return out


@pandas_udf(DoubleType())
def bayes_peak(n: pd.Series, mu: pd.Series) -> pd.Series:
    """log10 of the factor for a peak, once for each distinct pair of a batch; null for counts where none are expected."""
    return _paired(n, mu, log_peak_np)


@pandas_udf(DoubleType())
def bayes_eclipse(n: pd.Series, mu: pd.Series) -> pd.Series:
    return _paired(n, mu, log_eclipse_np)


def _paired(n: pd.Series, mu: pd.Series, factor) -> pd.Series:
    codes, pairs = pd.MultiIndex.from_arrays([n, mu]).factorize()
    known = [factor(int(k), float(m)) if k == k and m == m and m > 0 else None for k, m in pairs]
    return pd.Series([known[c] if c >= 0 else None for c in codes], dtype="float64")


def _slots(band: int, size: float) -> int:
    edge = min(90.0, max(abs(band * size - 90.0), abs((band + 1) * size - 90.0)))
    return max(1, math.floor(360.0 / size * math.cos(math.radians(edge))))


@udtf(returnType=_longs("band", "slot"))
class SkyCells:
    """The cell of a position, or with ``around`` all cells that can hold one within the radius (arcseconds)."""

    def eval(self, ra: float, dec: float, radius: float, around: bool) -> Iterator[tuple[int, int]]:
        if ra is None or dec is None:
            return
        size = max(float(radius) / 3600, 1e-4) * 1.0001
        own = math.floor((float(dec) + 90.0) / size)
        for band in (own - 1, own, own + 1) if around else (own,):
            n = _slots(band, size)
            at = min(math.floor(float(ra) % 360.0 / 360.0 * n), n - 1)
            yield from ((band, slot) for slot in ({(at - 1) % n, at, (at + 1) % n} if around else {at}))


@udtf(returnType=_longs("ix", "iy"))
class BoxPixels:
    """The pixels of a half-open box."""

    def eval(self, x0: int, y0: int, x1: int, y1: int) -> Iterator[tuple[int, int]]:
        if None not in (x0, y0, x1, y1):
            yield from ((x, y) for x in range(x0, x1) for y in range(y0, y1))


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("bayes_peak", bayes_peak)
    spark.udf.register("bayes_eclipse", bayes_eclipse)
    spark.udtf.register("sky_cells", SkyCells)
    spark.udtf.register("box_pixels", BoxPixels)
