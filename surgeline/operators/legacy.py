"""The older rule set: averages of the last seven days in the same hour, levels by fixed ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ATTRIBUTES, ITEM
from .outbox import DATASET_KINDS

# Thresholds and level names of the older rules.
LOOKBACK_DAYS = 7
MIN_CONSUMPTION = 300.0
MIN_DAYS = 4
ALERT_RATIO, BACKGROUND_RATIO, SESSION_RATIO = 1.2, 1.5, 1.8
LEVEL_ALERT = "T1_ALERT"
LEVEL_BACKGROUND = "T2_KILL_BG"
LEVEL_SESSION = "T3_KILL_SESSION"
LEVEL_ACTIONS = {LEVEL_ALERT: "alert", LEVEL_BACKGROUND: "cancel_background", LEVEL_SESSION: "cancel_sessions"}
SESSION_KINDS = ["Dataset", "SemanticModel"]


def legacy_reset(current: Column, previous: Column) -> Column:
    """Difference to the previous reading of the day; after a drop, the reading itself."""
    used = current - F.coalesce(previous, F.lit(0.0))
    return F.when(used < 0, current).otherwise(used)


def legacy_intervals(snapshots: DataFrame) -> DataFrame:
    """Consumption per reading within its day; the first reading of a day counts in full."""
    of_day = Window.partitionBy(*ITEM, "date").orderBy("ts")
    dated = snapshots.withColumn("date", F.to_date("ts"))
    previous = F.lag("cu_seconds_today").over(of_day)
    return dated.select(
        *ITEM,
        *ATTRIBUTES,
        "ts",
        "date",
        F.hour("ts").alias("hour_bucket"),
        legacy_reset(F.col("cu_seconds_today"), previous).alias("cu_interval"),
    )


def latest_ts(intervals: DataFrame, today: Column) -> DataFrame:
    return intervals.filter(F.col("date") == today).agg(F.max("ts").alias("latest_ts"))


def legacy_current(intervals: DataFrame, today: Column) -> DataFrame:
    """Rows of the latest reading of the day (a scalar subquery, nothing is collected)."""
    return intervals.filter((F.col("date") == today) & (F.col("ts") == latest_ts(intervals, today).scalar()))


def legacy_baseline(intervals: DataFrame, today: Column) -> DataFrame:
    """Plain average and distinct days per item and hour over the last seven days before today."""
    age = F.datediff(today, F.col("date"))
    return (
        intervals.filter((age >= 1) & (age <= LOOKBACK_DAYS))
        .groupBy(*ITEM, "hour_bucket")
        .agg(F.avg("cu_interval").alias("baseline_cu_s"), F.count_distinct("date").alias("baseline_days"))
    )


def legacy_scored(intervals: DataFrame, today: Column) -> DataFrame:
    """The latest readings against the average of their own hour, highest ratio first."""
    normal = legacy_baseline(intervals, today)
    joined = legacy_current(intervals, today).join(normal, [*ITEM, "hour_bucket"], "left")
    ratio = F.when(F.col("baseline_cu_s") != 0, F.col("cu_interval") / F.col("baseline_cu_s"))
    return joined.withColumn("ratio", ratio).orderBy(F.desc("ratio"), *ITEM)


def legacy_anomaly_filter(scored: DataFrame, min_consumption: float = MIN_CONSUMPTION) -> DataFrame:
    return scored.filter(
        (F.col("cu_interval") >= min_consumption)
        & (F.col("baseline_days") >= MIN_DAYS)
        & (F.col("ratio") >= ALERT_RATIO)
    )


def legacy_escalation(anomalies: DataFrame, mode: str, allowed: list[str]) -> DataFrame:
    """One row per level an anomaly reaches. Listed items, and all items outside of enforcing,
    are announced only."""
    ratio = F.col("ratio")
    armed = F.lit(mode.upper() == "ENFORCE") & ~F.col("item_id").isin(allowed)
    levels = F.array_compact(
        F.array(
            F.lit(LEVEL_ALERT),
            F.when(armed & (ratio >= BACKGROUND_RATIO), LEVEL_BACKGROUND),
            F.when(
                armed & (ratio >= SESSION_RATIO) & F.col("item_kind").isin(SESSION_KINDS), LEVEL_SESSION
            ),
        )
    )
    rows = anomalies.withColumn("level", F.explode(levels))
    action = F.lit(None).cast("string")
    for level, name in LEVEL_ACTIONS.items():
        action = F.when(F.col("level") == level, name).otherwise(action)
    return rows.withColumn("action", action).withColumn("mode", F.lit(mode))
