"""Audit reports over the event log, and summaries of cycles."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import naive
from ..functions.tiers import NONE
from ..schemas import CYCLE, EVENTS


def load_events(events: DataFrame, since: dt.datetime, capacity_key: str | None = None) -> DataFrame:
    """Events from a moment on, newest first."""
    chosen = events.filter(F.col("ts") >= naive(since))
    if capacity_key:
        chosen = chosen.filter(F.col("capacity_key") == capacity_key)
    return chosen.orderBy(F.desc("ts"))


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest events; ties are broken so that the cut is the same in every run."""
    return events.orderBy(F.desc("ts"), "capacity_key", "item_id").limit(limit)


def events_by_tier(events: DataFrame) -> DataFrame:
    """Events per detected tier, and how many of them a gate contained."""
    return events.groupBy("tier").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("tier") != F.col("effective_tier")).alias("contained"),
    )


def events_json(events: DataFrame) -> DataFrame:
    """Each event as a JSON object with every field, also the empty ones."""
    fields = F.struct(*[f.name for f in EVENTS.fields])
    return events.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def rank_assessments(assessed: DataFrame) -> DataFrame:
    """Worst first: by detected tier, then by ratio."""
    return assessed.orderBy(
        F.desc("tier"), F.desc(F.coalesce("ratio", F.lit(0.0))), "capacity_key", "item_id", "window_end"
    )


def would_counts(ratios: DataFrame) -> DataFrame:
    """How many intervals of each capacity reach each threshold (a kill also alerts)."""
    steps = F.col("policy")["thresholds"]
    return ratios.groupBy("capacity_key").agg(
        *[F.count_if(F.col("ratio") >= steps[t]).alias(f"would_{t}") for t in ("alert", "throttle", "kill")]
    )


def run_summary(snapshots: DataFrame, intervals: DataFrame, anomalies: DataFrame, results: DataFrame, capacities: DataFrame) -> DataFrame:
    """A row per capacity and cycle: items scanned, anomalies, actions taken, skipped intervals,
    and whether the cycle had nothing to compare with yet.

    `intervals` carry `comparable`; `results` say per anomaly whether an action was taken. All
    four are counted in one aggregation. Only enabled capacities have cycles.
    """
    one = F.lit(1)
    parts = [
        _counted(_enabled_only(snapshots, capacities).withColumnRenamed("ts", "window_end"), scanned=one),
        _counted(intervals, intervals=one, skipped=~F.col("comparable")),
        _counted(anomalies.filter(F.col("tier") > NONE), anomalies=one),
        _counted(results, taken=F.col("action_taken")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(*CYCLE).agg(
        F.sum("scanned").alias("items_scanned"),
        F.sum("anomalies").alias("anomalies"),
        F.sum("taken").alias("actions_taken"),
        F.sum("skipped").alias("skipped_intervals"),
        (F.sum("intervals") == 0).alias("bootstrap"),
    )


def run_log(summaries: DataFrame, failures: DataFrame, capacities: DataFrame, run_id: str, started_at: dt.datetime) -> DataFrame:
    """Summaries of a run's cycles under its name, with the capacity's mode and how many of its rows
    could not be read in the run."""
    modes = capacities.select("capacity_key", F.col("policy")["mode"].alias("mode"))
    errors = failures.filter("capacity_key IS NOT NULL").groupBy("capacity_key").agg(F.sum("rows").alias("_errors"))
    joined = summaries.join(modes, "capacity_key").join(errors, "capacity_key", "left")
    return joined.select(
        F.lit(run_id).alias("run_id"),
        naive(started_at).alias("started_at"),
        "capacity_key",
        "mode",
        "window_end",
        "items_scanned",
        "anomalies",
        "actions_taken",
        "skipped_intervals",
        "bootstrap",
        F.coalesce("_errors", F.lit(0)).alias("errors"),
    )


def _enabled_only(df: DataFrame, capacities: DataFrame) -> DataFrame:
    return df.join(capacities.filter("enabled").select("capacity_key"), "capacity_key", "left_semi")


COUNTERS = ["scanned", "intervals", "skipped", "anomalies", "taken"]


def _counted(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(*CYCLE, *[values.get(n, F.lit(0)).cast("int").alias(n) for n in COUNTERS])


def first_cycles(snapshots: DataFrame, intervals: DataFrame, capacities: DataFrame) -> DataFrame:
    """Cycles of an enabled capacity in which no item had an earlier reading to compare with."""
    scanned = _counted(_enabled_only(snapshots, capacities).withColumnRenamed("ts", "window_end"), scanned=F.lit(1))
    both = scanned.unionByName(_counted(intervals, intervals=F.lit(1)))
    sums = both.groupBy(*CYCLE).agg(F.sum("scanned").alias("items_scanned"), F.sum("intervals").alias("_n"))
    return sums.filter(F.col("_n") == 0).drop("_n")


def enforce_readiness(capacities: DataFrame, intervals: DataFrame, today: dt.date) -> DataFrame:
    """Enforcing capacities with the days of history in their lookback, and whether these suffice."""
    p = F.col("policy")
    enforcing = capacities.filter("enabled").filter(p["mode"] == "enforce")
    wanted = enforcing.select(
        "capacity_key",
        p["baseline"]["lookback_days"].alias("_lookback"),
        p["baseline"]["min_days"].alias("min_days"),
    )
    age = F.datediff(F.lit(today), F.to_date("window_end"))
    seen = (
        intervals.join(wanted.select("capacity_key", "_lookback"), "capacity_key")
        .filter((age >= 0) & (age <= F.col("_lookback")))
        .groupBy("capacity_key")
        .agg(F.count_distinct(F.to_date("window_end")).alias("_days"))
    )
    days = F.coalesce("_days", F.lit(0))
    return wanted.join(seen, "capacity_key", "left").select(
        "capacity_key", days.alias("history_days"), "min_days", (days >= F.col("min_days")).alias("ready")
    )


def collect_history_sql(spark, tables: dict[str, DataFrame], query: str) -> DataFrame:
    """Any SQL over the tables, under the names given."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)
