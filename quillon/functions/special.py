"""Closed forms of distribution functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    """Normal distribution function, to about 1e-7: a rational approximation of the complementary error function, JVM-side."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + z / 2)
    # fixed coefficients of the Chebyshev fit for erfc
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = F.lit(c) + t * poly
    erfc = t * F.exp(-z * z + poly)
    return F.when(x >= 0, 1 - erfc / 2).otherwise(erfc / 2)


def chi2_sf(x: Column, k: int) -> Column:
    """Upper tail of the chi-square distribution with k degrees of freedom."""
    h = x / 2
    if k % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, k // 2):
            term = term * h / i
            total = total + term
        return F.exp(-h) * total
    total = 2 * (1 - norm_cdf(F.sqrt(x)))
    term = F.sqrt(2 * x / math.pi) * F.exp(-h)
    for i in range(1, (k - 1) // 2 + 1):
        total = total + term
        term = term * x / (2 * i + 1)
    return total


def kolmogorov_sf(t: Column) -> Column:
    """Upper tail of the Kolmogorov distribution, by its alternating series."""
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, i: s + F.when(i % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * i * i * t * t))
    return F.when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * terms)))
