"""Statistics Spark has no built-in for, composed from value histograms.

A histogram ``(value, m)`` is bounded: user counts summing to N messages have
at most sqrt(2N) distinct values, durations at most one per second of the
range. The ordered windows below only ever see such tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.constants import POISSON_NORMAL_APPROX_LAMBDA
from parley.functions.core import partition

#: Terms of a series or fraction. Below the normal approximation (means under 30) 60 are enough for 1e-12.
STEPS = 120


def ranked_histogram(hist: DataFrame, value: str, by: Sequence[str], weight: str = "m") -> DataFrame:
    """Add ``below`` (rows with a smaller value) and ``n`` (all rows) per key."""
    ordered = partition(by).orderBy(value)
    upto = F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn("below", upto - F.col(weight)).withColumn("n", F.sum(weight).over(partition(by)))


def at_index(value: str, index: Column, weight: str = "m") -> Column:
    """Aggregate: the value at a zero-based index of the sorted rows."""
    inside = (F.col("below") <= index) & (index < F.col("below") + F.col(weight))
    return F.max(F.when(inside, F.col(value)))


def nearest_rank(value: str, q: float) -> Column:
    """Aggregate: the value at index round((n-1)*q) of a ranked histogram."""
    return at_index(value, F.round((F.col("n") - 1) * F.lit(q)).cast("bigint"))


def median(value: str) -> Column:
    """Aggregate: the interpolated median of a ranked histogram."""
    low = F.floor((F.col("n") - 1) / F.lit(2))
    high = F.ceil((F.col("n") - 1) / F.lit(2))
    return (at_index(value, low) + at_index(value, high)) / F.lit(2.0)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series eight places further on, where four terms are exact to 1e-12."""
    y = x + F.lit(8.0)
    back = reduce(lambda product, k: product * (x + F.lit(float(k))), range(1, 8), x)
    series = sum((F.lit(c) / F.pow(y, F.lit(p)) for c, p in ((1 / 12, 1.0), (-1 / 360, 3.0), (1 / 1260, 5.0), (-1 / 1680, 7.0))), F.lit(0.0))
    return (y - F.lit(0.5)) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(back)


def gamma_upper(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x) for a > 0, x > 0; its complement by ``gamma_lower``."""
    return F.when(x < a + 1, F.lit(1.0) - _gamma_series(a, x)).otherwise(_gamma_fraction(a, x))


def gamma_lower(a: Column, x: Column) -> Column:
    return F.when(x < a + 1, _gamma_series(a, x)).otherwise(F.lit(1.0) - _gamma_fraction(a, x))


def _gamma_front(a: Column, x: Column) -> Column:
    return F.exp(a * F.ln(x) - x - log_gamma(a))


def _gamma_series(a: Column, x: Column) -> Column:
    """x^a e^-x / gamma(a) times the sum of x^n / (a (a+1)...(a+n)), which converges fast below a + 1."""

    def step(state: Column, n: Column) -> Column:
        term = state["term"] * x / (a + n)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    first = F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("sum"))
    return _gamma_front(a, x) * F.aggregate(_steps(), first, step)["sum"]


def _gamma_fraction(a: Column, x: Column) -> Column:
    """The continued fraction of Q(a, x) from a + 1 on, evaluated from its far end."""
    last = F.lit(0.0)
    tail = F.aggregate(
        F.reverse(_steps()), last, lambda below, n: n * (n - a) / (x + F.lit(2.0) * n + F.lit(1.0) - a - below)
    )
    return _gamma_front(a, x) / (x + F.lit(1.0) - a - tail)


def _steps() -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda n: n.cast("double"))


def erfc(z: Column) -> Column:
    """The complementary error function."""
    tail = gamma_upper(F.lit(0.5), F.greatest(z * z, F.lit(1e-300)))
    return F.when(z < 0, F.lit(2.0) - tail).otherwise(tail)


def poisson_tail(k: Column | str, lam: Column | str, upper: Column) -> Column:
    """Poisson tail of a count: P(X >= k) where ``upper``, else P(X <= k); column expressions only.

    From ``POISSON_NORMAL_APPROX_LAMBDA`` on, the normal tail with continuity correction.
    """
    k, lam = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (k, lam))
    safe = F.greatest(lam, F.lit(1e-300))  # branches below never meet a mean of zero, whichever is computed
    half = F.when(upper, F.lit(-0.5)).otherwise(F.lit(0.5))
    z = (k + half - lam) / F.sqrt(F.lit(2.0) * safe)
    normal = F.lit(0.5) * erfc(F.when(upper, z).otherwise(-z))
    exact = F.when(upper, gamma_lower(F.greatest(k, F.lit(1.0)), safe)).otherwise(gamma_upper(F.greatest(k, F.lit(0.0)) + 1, safe))
    return (
        F.when(upper & (k <= 0), 1.0)
        .when(~upper & (k < 0), 0.0)
        .when(lam <= 0, F.when(upper, 0.0).otherwise(1.0))
        .when(lam >= F.lit(POISSON_NORMAL_APPROX_LAMBDA), normal)
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), exact)))
    )
