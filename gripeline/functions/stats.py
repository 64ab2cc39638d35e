"""Statistics as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of a published rational Chebyshev fit of erfc, of fractional error below 1.2e-7 (fixed values).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = reduce(lambda s, c: F.lit(c) + t * s, reversed(ERFC[:-1]), F.lit(ERFC[-1]))
    return t * F.exp(-x * x + poly)


def two_proportion_p(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two-sided p of the pooled test of k1/n1 against k2/n2; 1 if a side has fewer than five or the variance is zero."""
    pooled = F.try_divide((k1 + k2).cast("double"), n1 + n2)
    variance = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    z = F.try_divide(F.abs(F.try_divide(k1.cast("double"), n1) - F.try_divide(k2.cast("double"), n2)), F.sqrt(variance))
    return F.when((n1 < 5) | (n2 < 5), 1.0).otherwise(F.coalesce(erfc(z / F.sqrt(F.lit(2.0))), F.lit(1.0)))
