"""Calibration: what would the current thresholds have done, and which would fit better?"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calibrate import READ, calibration_report, item_profile
from ..operators.intervals import discard_count, with_cadence
from ..policy import policy_join
from ..session import materialize
from .replay import score_intervals


@dataclass(frozen=True)
class Calibration:
    report: DataFrame
    profiles: DataFrame


def calibrate(
    intervals: DataFrame,
    capacities: DataFrame,
    as_of: dt.date | None = None,
    days: int = 14,
) -> Calibration:
    """Calibrate on the `days` up to `as_of`, or on all intervals given. The replayed history is
    written once, as far as any statistic reads it, and read by each with just the columns it needs."""
    if as_of is not None:
        day = F.to_date("window_end")
        intervals = intervals.filter((day >= F.lit(as_of - dt.timedelta(days=days))) & (day <= F.lit(as_of)))
    discarded = discard_count(with_cadence(policy_join(intervals, capacities)))
    scored = score_intervals(intervals, capacities)
    stored = policy_join(materialize(scored.select(*READ), "calibration"), capacities)
    profiles = materialize(item_profile(stored), "profiles")
    return Calibration(calibration_report(stored, discarded, profiles, capacities), profiles)
