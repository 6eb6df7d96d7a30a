"""Interval estimates as column expressions over aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion, within [0, 1]; (0, 0) for no trials."""
    p = successes / n
    z2 = F.lit(z * z)
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    low, high = (F.when(n > 0, clamp(x)).otherwise(0.0) for x in (centre - half, centre + half))
    return low, high


def mean_interval(mean: Column, variance: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Normal interval of a mean from the sample variance, within [0, 1]; (0, 0) below two values."""
    half = F.lit(z) * F.sqrt(variance / n)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    low, high = (F.when(n >= 2, clamp(x)).otherwise(0.0) for x in (mean - half, mean + half))
    return low, high
