"""From cumulative readings to consumption per interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cadence import is_comparable, normalize
from ..functions.calendar import bucket_key, minutes_between
from ..schemas import ATTRIBUTES, CYCLE, ITEM
from .snapshots import previous_reading


def intervals_from_pairs(pairs: DataFrame) -> DataFrame:
    """Readings with their predecessor (`prev_ts`, `prev_cu`) become intervals.

    The counter restarts at midnight: on a new day, or after a drop, the reading itself is what
    was consumed. Items without an earlier reading yield nothing.
    """
    same_day = F.to_date("prev_ts") == F.to_date("ts")
    grown = F.col("cu_seconds_today") >= F.col("prev_cu")
    consumed = F.when(same_day & grown, F.col("cu_seconds_today") - F.col("prev_cu")).otherwise(
        F.col("cu_seconds_today")
    )
    return pairs.filter(F.col("prev_ts") < F.col("ts")).select(
        *ITEM,
        *ATTRIBUTES,
        F.col("prev_ts").alias("window_start"),
        F.col("ts").alias("window_end"),
        F.greatest(F.lit(0.0), consumed).alias("cu_seconds"),
    )


def interval_pairing(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One cycle: join the current readings with the previous ones of the same items."""
    before = previous.select(
        *ITEM, F.col("ts").alias("prev_ts"), F.col("cu_seconds_today").alias("prev_cu")
    )
    return current.join(before, ITEM)


def derive_intervals(snapshots: DataFrame, chunk: str = "day") -> DataFrame:
    """Every cycle of a history at once. Needs (item, ts) unique, as the snapshot table keeps it."""
    return intervals_from_pairs(previous_reading(snapshots, chunk))


def with_cadence(intervals: DataFrame) -> DataFrame:
    """With the policy joined: minutes, consumption at the expected cadence, bucket, comparable."""
    p = F.col("policy")
    return (
        intervals.withColumn("minutes", minutes_between(F.col("window_start"), F.col("window_end")))
        .withColumn(
            "normalized",
            normalize(F.col("cu_seconds"), F.col("minutes"), p["interval_minutes"]),
        )
        .withColumn("bucket", bucket_key(F.col("window_end"), p["baseline"]["bucket"]))
        .withColumn(
            "comparable",
            is_comparable(
                F.col("minutes"), p["interval_minutes"], p["guards"]["max_interval_stretch"]
            ),
        )
    )


def capacity_total(intervals: DataFrame) -> DataFrame:
    """Consumption of a capacity in a cycle."""
    return intervals.groupBy(*CYCLE).agg(F.sum("cu_seconds").alias("cu_seconds"))


def discard_count(intervals: DataFrame) -> DataFrame:
    """Intervals kept as history but not judged, per capacity."""
    return intervals.groupBy("capacity_key").agg(
        F.count("*").alias("intervals"), F.count_if(~F.col("comparable")).alias("discarded")
    )
