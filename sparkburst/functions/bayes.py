"""Poisson significance: Bayes factors, thresholds and their inverses."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import gamma

#: log10 thresholds of peaks and eclipses at 3 and 5 sigma.
PEAK_3, PEAK_5 = 5.94096891658419, 13.278830271385576
ECLIPSE_3, ECLIPSE_5 = 5.708917345972507, 12.380488516107011


def log_peak(n: Column, mu: Column) -> Column:
    """log10 of Q(n + 1, mu) / pmf(n; mu), in constant work.  Null for counts where none are expected."""
    return gamma.log10_upper(n, mu)


def log_eclipse(n: Column, mu: Column) -> Column:
    """log10 of P(n + 1, mu) / pmf(n; mu), in constant work."""
    return gamma.log10_lower(n, mu)


def log_eclipse_np(n: float, mu: float) -> float:
    """The same by log-sum-exp."""
    k = np.arange(1, math.ceil(max(mu - n, 0) + 10 * math.sqrt(mu) + 60) + 1)
    logs = np.cumsum(math.log(mu) - np.log(n + k))
    top = logs.max()
    return float((top + math.log(np.exp(logs - top).sum())) / math.log(10))


def log_peak_np(n: int, mu: float) -> float:
    """log10 B_peak by log-sum-exp, until its terms vanish."""
    if n <= 0:
        return 0.0
    last = max(0, n - math.ceil(max(n - mu, 0) + 10 * math.sqrt(n) + 60))
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(n, last, -1)) - math.log(mu))))
    top = logs.max()
    return float((top + math.log(np.exp(logs - top).sum())) / math.log(10))


def gaussian_peak_counts(mu: Column, sigma: float) -> Column:
    return F.ceil((2 * mu + sigma**2 + F.sqrt(8 * mu * sigma**2 + sigma**4)) / 2)


def gaussian_eclipse_counts(mu: Column, sigma: float) -> Column:
    return F.floor((2 * mu + sigma**2 - F.sqrt(8 * mu * sigma**2 + sigma**4)) / 2)


@cache
def threshold(kind: str, sigma: float, mu: float = 1000.0) -> float:
    """The Bayes factor that a deviation of ``sigma`` has at a high expectation."""
    root = math.sqrt(8 * mu * sigma**2 + sigma**4)
    if kind == "peak":
        return log_peak_np(math.ceil((2 * mu + sigma**2 + root) / 2), mu)
    return log_eclipse_np(math.floor((2 * mu + sigma**2 - root) / 2), mu)


def least_peak(mu: float, limit: float) -> int:
    """The first n whose B_peak exceeds the limit; B_peak grows with n."""
    lo, hi = 0, 1
    while log_peak_np(hi, mu) <= limit:
        lo, hi = hi, hi * 2
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if log_peak_np(mid, mu) <= limit else (lo, mid)
    return hi


def greatest_eclipse(mu: float, limit: float) -> int:
    """The first n whose B_eclipse is below the limit; it falls with n."""
    lo, hi = 0, max(1, math.floor(mu))
    if log_eclipse_np(0, mu) < limit:
        return 0
    while log_eclipse_np(hi, mu) >= limit:
        lo, hi = hi, hi * 2
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if log_eclipse_np(mid, mu) >= limit else (lo, mid)
    return hi


def _crossing(kind: str, n: int, limit: float, top: float) -> float:
    """The expectation at which n counts are just at the limit, by bisection of its logarithm."""
    lo, hi = math.log(1e-9), math.log(1.4 * top)
    for _ in range(50):
        mid = (lo + hi) / 2
        below = log_peak_np(n, math.exp(mid)) > limit if kind == "peak" else log_eclipse_np(n, math.exp(mid)) < limit
        lo, hi = (mid, hi) if below else (lo, mid)
    # a count that is at the limit itself is not beyond it
    return math.exp(lo) * (1 - 1e-9)


def crossings(spark: SparkSession, sigma: float = 3, top: float = 1000.0) -> DataFrame:
    """(kind, n, mu): below mu, n counts are a peak, or are few enough for an eclipse; for all n that matter up to ``top``.

    Both factors are monotone in the expectation, so a table over the counts
    holds what a search at every expectation would find.
    """
    limits = {k: threshold(k, sigma) for k in ("peak", "eclipse")}
    most = math.ceil((2 * top + sigma**2 + math.sqrt(8 * top * sigma**2 + sigma**4)) / 2) + 2

    def run(batches):
        for pdf in batches:
            n = pdf["id"].tolist()
            yield pd.DataFrame({"kind": [k for k in limits for _ in n], "n": n * 2, "mu": [_crossing(k, x, limits[k], top) if x or k == "eclipse" else 0.0 for k in limits for x in n]})

    return spark.range(0, most, 1, 8).mapInPandas(run, "kind string, n long, mu double")


def limit_table(spark: SparkSession, sigma: float = 3, points: int = 50_000, more: int = 1_000) -> DataFrame:
    """(k, mu, n_peak, n_eclipse) on the geometric grids 1e-7..1e3 and 1e3..1e6, k numbering them.

    Up to 1e3 the first counts beyond the thresholds, above it the counts of the
    Gaussian regime.
    """
    found = crossings(spark, sigma).orderBy("n").collect()  # a number of rows that sigma alone decides
    at = {k: np.array([r["mu"] for r in found if r["kind"] == k]) for k in ("peak", "eclipse")}

    def fill(batches):
        for pdf in batches:
            k = pdf["id"].to_numpy()
            low = 10.0 ** (-7 + 10 * k / max(1, points - 1))
            high = 10.0 ** (3 + 3 * (k - points) / max(1, more - 1))
            mu = np.where(k < points, low, high)
            root = np.sqrt(8 * mu * sigma**2 + sigma**4)
            gauss = np.ceil((2 * mu + sigma**2 + root) / 2), np.floor((2 * mu + sigma**2 - root) / 2)
            n = [np.where(k < points, np.searchsorted(at[kind], mu, side="right"), g).astype(np.int64) for kind, g in zip(("peak", "eclipse"), gauss, strict=True)]
            yield pd.DataFrame({"k": k, "mu": mu, "n_peak": n[0], "n_eclipse": n[1]})

    return spark.range(0, points + more, 1, 4).mapInPandas(fill, "k long, mu double, n_peak long, n_eclipse long")


def factors_at_1000(counts: DataFrame) -> DataFrame:
    """Rows with the factors (b_peak, b_eclipse) of their counts n where 1000 are expected, however many they are."""
    mu = F.lit(1000.0)
    return counts.withColumns({"b_peak": log_peak(F.col("n"), mu), "b_eclipse": log_eclipse(F.col("n"), mu)})


def knot_below(cells: DataFrame, limits: DataFrame, points: int = 50_000, more: int = 1_000) -> DataFrame:
    """Cells with the row of the limit table (k, n_peak, n_eclipse) at or below their mu: its number follows from the grid."""
    low = F.least(F.floor((F.log10("mu") + 7) * ((points - 1) / 10)), F.lit(points - 1))
    high = F.least(points + F.floor((F.log10("mu") - 3) * ((more - 1) / 3)), F.lit(points + more - 1))
    k = F.when(F.col("mu") >= 1000, high).otherwise(low).cast("long")
    return cells.withColumn("k", k).join(limits.drop("mu"), "k")


def significant(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds is_peak and is_eclipse by linear interpolation of the limit table in mu; outside the table neither."""
    rows = limits.orderBy("k").toPandas()  # a table of fixed size
    grid, peak, eclipse = (rows[c].to_numpy(dtype=float) for c in ("mu", "n_peak", "n_eclipse"))

    def of(values: np.ndarray):
        @F.pandas_udf(DoubleType())
        def at(mu: pd.Series) -> pd.Series:
            return pd.Series(np.interp(mu.to_numpy(dtype=float), grid, values, left=np.nan, right=np.nan))

        return at(F.col("mu"))

    n = F.col("n").cast("double")
    held = cells.withColumn("_p", of(peak)).withColumn("_e", of(eclipse))
    up, down = F.coalesce(~F.isnan("_p") & (n > F.col("_p")), F.lit(False)), F.coalesce(~F.isnan("_e") & (n < F.col("_e")), F.lit(False))
    return held.withColumn("is_peak", up).withColumn("is_eclipse", down).drop("_p", "_e")


@cache
def _stairs(kind: str, mu: float = 1000.0, most: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """The factors of rising deviations at a high expectation, and the sigma from which each count is the Gaussian one."""
    edge = math.sqrt(8 * mu * most**2 + most**4)
    if kind == "peak":
        n = np.arange(int(mu), math.ceil((2 * mu + most**2 + edge) / 2) + 1)
        x = np.maximum(n - 1 - mu, 0.0)  # the count is reached just after its predecessor
        return np.array([log_peak_np(int(k), mu) for k in n]).round(9), np.sqrt(x * x / (x + 2 * mu))
    n = np.arange(int(mu), math.floor((2 * mu + most**2 - edge) / 2) - 1, -1)
    x = np.maximum(mu - (n + 1), 0.0)
    return np.array([log_eclipse_np(int(k), mu) for k in n]).round(9), np.sqrt(x * x / (2 * mu - x))


def sigma_of_factor(b: Column, is_peak: Column) -> Column:
    """The sigma at which the threshold at a high expectation first reaches a factor; 0 below that of one sigma, 10 above that of ten.

    A binary search of a fixed number of steps in a table of some hundred steps.
    """

    def of(kind: str) -> Column:
        steps, sigma = _stairs(kind)
        have, n = F.lit(steps.tolist()), len(steps)

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            less = F.get(have, mid) < b
            return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(less, s["hi"]).otherwise(mid).alias("hi")))

        ends = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
        at = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), ends, halve, lambda s: F.least(s["lo"], F.lit(n - 1)))
        got = F.get(F.lit(sigma.tolist()), at)
        return F.when(F.isnan(b), b).when(b < threshold(kind, 1.0), 0.0).when(b >= threshold(kind, 10.0), 10.0).otherwise(got)

    return F.when(is_peak, of("peak")).otherwise(of("eclipse"))


def sigma_equivalent(n: Column, mu: Column) -> Column:
    """The sigma at which (n, mu) is just significant: as a peak if n > mu, else as an eclipse; null without an expectation."""
    up = n > mu
    # rounded, so that a factor that equals a step's is on it
    b = F.round(F.when(up, log_peak(n, mu)).otherwise(log_eclipse(n, mu)), 9)
    return F.when(mu > 0, sigma_of_factor(F.coalesce(b, F.lit(float("nan"))), F.coalesce(up, F.lit(False))))


def _rate_at(n: int, q: float) -> float:
    """The Poisson mean at which P(N > n) = q."""
    k = np.arange(0, n + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))
    lo, hi = 1e-9, n + 20 + 10 * math.sqrt(n + 1)
    for _ in range(80):
        mid = (lo + hi) / 2
        above = 1 - float(np.exp(-mid + k * math.log(mid) - logs).sum())
        lo, hi = (mid, hi) if above < q else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def rate_quantile(n: pd.Series, q: pd.Series) -> pd.Series:
    """The Poisson mean at which P(N > n) = q: the inverse regularised gamma function, once for each distinct pair of a batch."""
    pairs = pd.MultiIndex.from_arrays([n, q])
    codes, distinct = pairs.factorize()
    return pd.Series(np.array([_rate_at(int(k), float(p)) for k, p in distinct])[codes] if len(n) else np.zeros(0))


def log_pmf(n: Column, mu: Column) -> Column:
    """Natural log of the Poisson probability."""
    return gamma.log_pmf(n, mu)
