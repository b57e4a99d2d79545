"""From a raw usage log to cumulative-since-midnight readings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import end_of_hour
from ..schemas import ATTRIBUTES, ITEM

IDENTITY = ["capacity_key", "capacity_id", "item_id", *ATTRIBUTES]
DESCRIBED = [c for c in IDENTITY if c not in ITEM]
BY_DAY = ["item_id", "capacity_key", "_of"]  # the item leads sorts, as it tells more rows apart


def semi_capacity(usage: DataFrame, capacities: DataFrame) -> DataFrame:
    """Usage of the listed capacities only."""
    return usage.join(capacities.select("capacity_id"), "capacity_id", "left_semi")


def _summed(usage: DataFrame, **keys: Column) -> DataFrame:
    """Use per item and key, with the newest description.

    Descriptions are grouping keys at first: sums and times fit a hash aggregate, which combines the
    log before the shuffle and never sorts it. Only the few rows left, one more wherever an item was
    renamed within a key, are compared by description. They are dealt by item and day, as running sums
    need them, and stay in order of item, day and key.
    """
    by = [f"_{n}" for n in keys]
    named = usage.select(*ITEM, *DESCRIBED, "ts", "cu_seconds", *[c.alias(f"_{n}") for n, c in keys.items()])
    sums = named.groupBy(*ITEM, *by, *DESCRIBED).agg(F.max("ts").alias("_at"), F.sum("cu_seconds").alias("_part"))
    dealt = sums.withColumn("_of", F.to_date(by[0])).repartition(*ITEM, "_of")
    newest = F.max(F.struct("_at", *DESCRIBED)).alias("_newest")
    joined = dealt.groupBy(*BY_DAY, *by).agg(newest, F.sum("_part").alias("_used"))
    return joined.select(*ITEM, *[F.col(f"_newest.{c}").alias(c) for c in DESCRIBED], "_of", *[F.col(f"_{n}").alias(n) for n in keys], "_used")


def daily_cumulative(usage: DataFrame, on: dt.date | None = None) -> DataFrame:
    """Consumption per item and day, for one day or all. Partial sums run before the shuffle, so
    an item holding most of the log costs one row per map task."""
    day = F.to_date("ts")
    chosen = usage if on is None else usage.filter(day == F.lit(on))
    return _summed(chosen, day=day).select(*IDENTITY, "day", F.col("_used").alias("cu_seconds_today"))


def cumulative_snapshots(usage: DataFrame, reading_time: Column | None = None) -> DataFrame:
    """The reading every cycle of the log would have taken: running sum since midnight.

    The log is first summed to one row per item and reading time, which both combines map-side
    and makes (item, ts) unique, also when an item is renamed between two readings. The running sum
    is then partitioned by item and day, so a group never exceeds one day's readings.
    """
    at = end_of_hour(F.col("ts")) if reading_time is None else reading_time
    so_far = (
        Window.partitionBy(*BY_DAY)
        .orderBy("ts")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _summed(usage, ts=at)
        .withColumn("cu_seconds_today", F.sum("_used").over(so_far))
        .select("ts", *IDENTITY, "cu_seconds_today")
    )
