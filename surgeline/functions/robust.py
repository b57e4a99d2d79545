"""Robust summaries of a sorted array of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The quantile each baseline method stands for.
METHOD_QUANTILES = {"p75": 0.75, "p90": 0.90}
TRIM_FROM_SAMPLES = 4


def nearest_index(n: Column, quantile: float | Column) -> Column:
    """Zero-based nearest rank with banker's rounding; no built-in percentile rounds this way."""
    q = F.lit(quantile) if isinstance(quantile, float) else quantile
    return F.least(n - 1, F.bround(q * (n - 1)).cast("long"))


def trim_top(ascending: Column, percent: Column) -> Column:
    """Drop the top `percent` of four or more samples, always leaving one."""
    n = F.size(ascending)
    keep = F.greatest(F.lit(1), F.floor(n * (1 - percent / 100.0)).cast("int"))
    return F.when((percent > 0) & (n >= TRIM_FROM_SAMPLES), F.slice(ascending, 1, keep)).otherwise(
        ascending
    )


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)


def median_of(ascending: Column) -> Column:
    n = F.size(ascending)
    low = F.get(ascending, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ascending, F.floor(n / 2).cast("int"))
    return (low + high) / 2.0


def quantile_of(ascending: Column, quantile: float) -> Column:
    n = F.size(ascending)
    return F.get(ascending, nearest_index(n, quantile).cast("int"))


def summarize(ascending: Column, method: Column) -> Column:
    """Mean, median, p75 or p90 of non-empty ascending samples; NULL for none."""
    chosen = F.when(method == "mean", mean_of(ascending)).when(
        method == "median", median_of(ascending)
    )
    for name, quantile in METHOD_QUANTILES.items():
        chosen = chosen.when(method == name, quantile_of(ascending, quantile))
    return F.when(F.size(ascending) > 0, chosen)
