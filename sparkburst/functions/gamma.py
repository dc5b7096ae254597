"""Poisson probabilities and their tails as column expressions of constant work.

Sums over counts are folded only up to ``FEW`` terms.  Beyond, a tail over the
probability of the count itself is an integral,

    sum over j >= 0 of n! / ((n - j)! mu^j)         = integral of exp(n log(1 + t / mu) - t) over t from 0,
    sum over j >= 1 of mu^j / ((n + 1) .. (n + j))  = mu * integral of exp(n log(1 - s) + mu s) over s from 0 to 1,

and of the two the one whose integrand falls from its start, the first where
n <= mu and the second elsewhere, is summed at fixed nodes after its own decay
length; the other follows, as both together are one over the probability.  So a
count of a million costs what one of a hundred does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counts up to which sums are folded and factorials looked up.
FEW = 64
#: Terms of a series whose ratio is below FEW / (FEW + j): the rest is under 1e-17 of it.
_TERMS = 110


def _nodes(step: float = 0.1, lo: float = -4.4, hi: float = 4.0) -> list[tuple[float, float]]:
    """Places z and weights of the trapezoid rule after z = exp(y - exp(-y)), which suits what falls like an exponential."""
    out = []
    for k in range(round((hi - lo) / step) + 1):
        y = lo + k * step
        z = math.exp(y - math.exp(-y))
        out.append((z, step * z * (1 + math.exp(-y))))
    return out


def _quadrature(scale: Column, exponent) -> Column:
    """The integral from 0 of exp(exponent(t)), which falls over about ``scale``."""
    nodes = F.array(*[F.struct(F.lit(z).alias("z"), F.lit(w).alias("w")) for z, w in _nodes()])
    with_scale = F.transform(nodes, lambda x: F.coalesce(x["w"] * F.exp(exponent(scale * x["z"])), F.lit(0.0)))
    return scale * F.aggregate(with_scale, F.lit(0.0), lambda a, x: a + x)


def _once(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers: a table up to ``FEW``, then Stirling's series."""
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(FEW + 1)])
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + _stirling(x)
    return F.when(n <= FEW, F.get(table, n.cast("int"))).otherwise(series)


def _stirling(x: Column) -> Column:
    r = 1 / (x * x)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x


def log_pmf(n: Column, mu: Column) -> Column:
    """Natural log of the Poisson probability of n; many counts near mu by their distance from it, so that nothing large cancels."""
    x = (mu - n) / n
    near = -n * (x - F.log1p(x)) - 0.5 * F.log(2 * math.pi * n) - _stirling(n.cast("double"))
    return F.when((n > FEW) & (F.abs(x) < 0.5), near).otherwise(n * F.log(mu) - mu - log_factorial(n))


def _falling(n: Column, mu: Column) -> Column:
    """The ratio of the two whose integrand falls, for more than ``FEW`` counts."""
    n, mu = n.cast("double"), mu.cast("double")
    below = 1 - n / mu
    of_peak = 2 / (below + F.sqrt(below * below + 2 * n / (mu * mu)))
    over = n - mu
    of_eclipse = 2 / (over + F.sqrt(over * over + 2 * n))
    peak = _once(of_peak, lambda s: _quadrature(s, lambda t: n * F.log1p(t / mu) - t))
    # nothing is left beyond s = 1
    eclipse = mu * _once(of_eclipse, lambda s: _quadrature(s, lambda t: F.when(t < 1, n * F.log1p(-t) + mu * t)))
    return F.when(n <= mu, peak).otherwise(eclipse)


def _fold_peak(n: Column, mu: Column) -> Column:
    """(log10) the sum over j = 0..n of n! / ((n - j)! mu^j) for at most ``FEW`` counts: a mantissa and a decimal exponent."""
    steps = F.when((n > 0) & (n <= FEW), F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("e"))

    def step(s: Column, k: Column) -> Column:
        m = F.pow(F.lit(10.0), -s["e"]) + s["m"] * F.try_divide(k, mu)
        big = m > 1e200
        return F.struct(F.when(big, m / 1e200).otherwise(m).alias("m"), F.when(big, s["e"] + 200.0).otherwise(s["e"]).alias("e"))

    return F.aggregate(steps, start, step, lambda s: F.log10(s["m"]) + s["e"])


def _series_eclipse(n: Column, mu: Column) -> Column:
    """The sum over j >= 1 of mu^j / ((n + 1) .. (n + j)) where mu < n <= ``FEW``."""
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    step = lambda s, j: _once(s["t"] * mu / (n + j), lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step, lambda s: s["s"])


def log10_upper(n: Column, mu: Column) -> Column:
    """log10 of Q(n + 1, mu) over the probability of n; null for counts where none are expected."""
    rest = lambda pmf: (F.log1p(-_falling(n, mu) * F.exp(pmf)) - pmf) / math.log(10)
    many = F.when(n <= mu, F.log10(_falling(n, mu))).otherwise(_once(log_pmf(n, mu), rest))
    return F.when(n <= FEW, _fold_peak(n, mu)).otherwise(F.when(mu > 0, many))


def log10_lower(n: Column, mu: Column) -> Column:
    """log10 of P(n + 1, mu) over the probability of n."""
    ln10 = math.log(10)
    none = mu / ln10 + F.log10(-F.expm1(-mu))
    # one over the probability, less the other tail
    few = _once(log_pmf(n, mu), lambda pmf: (F.log1p(-F.exp(F.least(F.lit(0.0), _fold_peak(n, mu) * ln10 + pmf))) - pmf) / ln10)
    many = _once(log_pmf(n, mu), lambda pmf: (F.log1p(-_falling(n, mu) * F.exp(pmf)) - pmf) / ln10)
    of_few = F.when(mu < n, F.log10(_series_eclipse(n, mu))).otherwise(few)
    of_many = F.when(mu < n, F.log10(_falling(n, mu))).otherwise(many)
    return F.when(n == 0, none).when(n <= FEW, of_few).otherwise(of_many)
