"""Severity tiers and the ratio that decides them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity labels, the array position is the rank.
TIERS = ["none", "alert", "throttle", "kill"]
NONE, ALERT, THROTTLE, KILL = range(4)


def tier_label(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank + 1)


def tier_rank(label: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(t) for t in TIERS]), label) - 1).cast("int")


def trustworthy(baseline: Column) -> Column:
    return F.coalesce((baseline["days"] > 0) & (baseline["value"] > 0), F.lit(False))


def ratio_to_baseline(normalized: Column, baseline: Column) -> Column:
    """NULL unless the baseline is trustworthy; never divides by zero, also under ANSI mode."""
    return F.when(trustworthy(baseline), normalized / baseline["value"])


def classify(ratio: Column, thresholds: Column) -> Column:
    """Highest tier whose (inclusive) threshold the ratio reaches; a NULL ratio is no anomaly."""
    return (
        F.when(ratio >= thresholds["kill"], KILL)
        .when(ratio >= thresholds["throttle"], THROTTLE)
        .when(ratio >= thresholds["alert"], ALERT)
        .otherwise(NONE)
    )


def is_suppressed(tier: Column, effective: Column) -> Column:
    return (tier > NONE) & (effective < tier)
