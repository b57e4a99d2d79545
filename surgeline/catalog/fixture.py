"""The given tables seen as usage logs of monitored capacities.

`events` is an hourly log: three capacities, an item per event type. `lineitem` is a daily log
whose number of items grows with the tables: an item per supplier.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import end_of_day, end_of_hour
from ..operators.intervals import derive_intervals
from ..policy import PolicySet
from ..sources.usage import cumulative_snapshots

# item: name, kind, workspace id, workspace name
ITEMS = {
    "signup": ("Signup Model", "SemanticModel", "ws-1", "Core"),
    "view": ("Page Views", "Dataset", "ws-1", "Core"),
    "click": ("Click Stream", "Notebook", "ws-2", "Streams"),
    "error": ("Regulatory Errors", "Pipeline", "", ""),
    "purchase": ("Sales Purchases", "SemanticModel", "ws-3", ""),
}

HOURLY = {
    "mode": "enforce",
    "interval_minutes": 60,
    "guards": {"min_cu_seconds": 20.0, "consecutive_breaches": 1, "max_actions_per_run": 2},
    "notify": [{"kind": "console"}, {"kind": "teams", "url": "https://example.org/hook", "min_tier": "kill"}],
}

CAPACITIES = [
    {"key": "C0", "id": "CAP-0", "sku": "EM1", "overrides": {"guards": {"cooldown_minutes": 180}}},
    {
        "key": "C1",
        "id": "cap-1",
        "sku": "em2",
        "overrides": {
            "baseline": {"method": "p75", "lookback_days": 28, "bucket": "hour_of_week", "min_days": 2},
            "guards": {
                "consecutive_breaches": 2,
                "cooldown_minutes": 60,
                "max_actions_per_run": 1,
                "min_capacity_utilization_percent": 4.0,
            },
            "protect": {"item_kinds": ["Pipeline"], "name_patterns": ["^sales"]},
            "freeze_windows": [
                {"name": "morning", "days": [0, 1, 2, 3, 4], "start_hour": 8, "end_hour": 12},
                {"name": "month_end", "days": [], "days_of_month": [29, 30]},
            ],
        },
    },
    {
        "key": "C2",
        "id": "cap-2",
        "overrides": {
            "mode": "observe",
            "baseline": {"method": "p90", "trim_top_percent": 0.0, "lookback_days": 14},
            "thresholds": {"alert": 1.1},
            "protect": {"workspace_ids": ["ws-2"]},
        },
    },
    {"key": "C3", "id": "cap-3", "enabled": False},
    {"key": "C4", "id": "cap-4", "sku": "X9"},
]

# Plain settings, the same for all capacities.
PLAIN_CAPACITIES = [{"key": f"C{i}", "id": f"cap-{i}"} for i in range(3)]

DAILY = {
    "mode": "enforce",
    "interval_minutes": 1440,
    "baseline": {"lookback_days": 90, "method": "median"},
    "guards": {"min_cu_seconds": 10.0, "max_actions_per_run": 20, "cooldown_minutes": 2880},
}


@lru_cache(maxsize=1)
def policy_set() -> PolicySet:
    return PolicySet(CAPACITIES, HOURLY)


def plain_set(**baseline) -> PolicySet:
    return PolicySet(PLAIN_CAPACITIES, HOURLY | {"baseline": baseline})


@lru_cache(maxsize=1)
def daily_set() -> PolicySet:
    return PolicySet(PLAIN_CAPACITIES, DAILY)


def capacities(spark: SparkSession, policies: PolicySet | None = None) -> DataFrame:
    return (policies or policy_set()).frame(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attribute(position: int) -> Column:
    chosen = F.lit(None).cast("string")
    for item, values in ITEMS.items():
        chosen = F.when(F.col("event_type") == item, values[position]).otherwise(chosen)
    return chosen


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("user_id") % 3).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("C"), number).alias("capacity_key"),
        F.concat(F.lit("cap-"), number).alias("capacity_id"),
        F.col("event_type").alias("item_id"),
        _attribute(0).alias("item_name"),
        _attribute(1).alias("item_kind"),
        _attribute(2).alias("workspace_id"),
        _attribute(3).alias("workspace_name"),
        F.col("value").alias("cu_seconds"),
    )


def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("l_suppkey") % 3).cast("string")
    item = F.col("l_suppkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("C"), number).alias("capacity_key"),
        F.concat(F.lit("cap-"), number).alias("capacity_id"),
        item.alias("item_id"),
        F.concat(F.lit("Supplier "), item).alias("item_name"),
        F.lit("Dataset").alias("item_kind"),
        F.lit("ws-1").alias("workspace_id"),
        F.lit("Core").alias("workspace_name"),
        F.col("l_quantity").alias("cu_seconds"),
    )


def _rounded(readings: DataFrame) -> DataFrame:
    """To the fixture's two decimals, so that sums in another order compare alike."""
    return readings.withColumn("cu_seconds_today", F.round("cu_seconds_today", 2))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cumulative_snapshots(usage(spark, sf_dir)))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_intervals(snapshots(spark, sf_dir))


def daily_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cumulative_snapshots(daily_usage(spark, sf_dir), end_of_day(F.col("ts"))))


def daily_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_intervals(daily_snapshots(spark, sf_dir), chunk="year")


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was running on each item in each hour: every event of the hour is a refresh, a job or
    a session, in some state."""
    number = F.col("user_id")
    events = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("refresh"), F.lit("job"), F.lit("session")), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.element_at(
        F.array(F.lit("Unknown"), F.lit("InProgress"), F.lit("NotStarted"), F.lit("Completed")),
        (number % 4 + 1).cast("int"),
    )
    return events.select(
        F.concat(F.lit("C"), (number % 3).cast("string")).alias("capacity_key"),
        F.col("event_type").alias("item_id"),
        end_of_hour(F.col("ts").cast("timestamp_ntz")).alias("window_end"),
        kind.alias("work_kind"),
        F.col("event_id").cast("string").alias("target"),
        status.alias("status"),
    )
