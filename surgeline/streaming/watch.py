"""The watch itself: a stream of readings in, the tables of `WatchTables` kept up to date.

A micro-batch may hold one cycle or many. One scan parts its rows into readings and a quarantine; the
readings are differenced against each item's last one, judged against stored day samples, and gated with
the stored state through the same operators as a batch replay, so a budget is counted by aggregation and
no capacity is gathered in one task. Of the history a batch reads the days within the lookback, thinned
to the buckets it judges. Everything is written under the batch's number; a batch that is run again
overwrites itself, and the ledger keeps an action from being planned under two numbers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.baselines import day_samples, lookback_classes
from ..operators.intervals import derive_intervals, with_cadence
from ..operators.outbox import (
    action_results,
    action_taken,
    action_targets,
    alert_outbox,
    event_projection,
    planned_actions,
    with_results,
)
from ..operators.report import run_log, run_summary
from ..operators.snapshots import dedup_latest_by_key
from ..plans.replay import final_state, gate_history, score_fresh
from ..policy import policy_join
from ..schemas import INTERVALS, ITEM, SNAPSHOTS, TEXT, TIME, record
from ..session import materialize
from ..sources.columns import clean_snapshots, failure_marks, isolate
from ..sources.tables import WatchTables

WORK = record(capacity_key=TEXT, item_id=TEXT, window_end=TIME, work_kind=TEXT, target=TEXT, status=TEXT)
DAY = dt.timedelta(days=1)


def fresh_intervals(readings: DataFrame, last: DataFrame, chunk: str = "day") -> DataFrame:
    """Intervals closed by new readings; readings not newer than the item's last one are ignored."""
    seen = last.select(*ITEM, F.col("ts").alias("_seen"))
    newer = readings.join(seen, ITEM, "left").filter(F.col("_seen").isNull() | (F.col("ts") > F.col("_seen")))
    return derive_intervals(newer.drop("_seen").unionByName(last), chunk)


def readable(batch: DataFrame, number: int, store: WatchTables, today: dt.date) -> tuple[DataFrame, DataFrame]:
    """The batch's readings, written once, and its failure marks. What cannot be read is set aside
    with the reason, and stops nothing else."""
    counted = Observation(f"isolated-{number}")
    isolated = isolate(batch).observe(counted, F.count_if(F.col("reason").isNotNull()).alias("unreadable"))
    rows = materialize(isolated, "isolated")
    failures = failure_marks(rows)
    if counted.get["unreadable"]:
        failures = materialize(failures, "failures")
        whole = F.to_json(F.struct(*batch.columns)).alias("row")
        store.write_quarantine(rows.filter("reason IS NOT NULL").select("capacity_key", "reason", whole), failures, today, number)
    good = rows.filter("reason IS NULL").select(
        F.col("capacity_key").cast("string").alias("capacity_key"),
        F.col("ts").cast("string").cast("timestamp_ntz").alias("ts"),
        *[(F.col(c) if c in batch.columns else F.lit(None)).cast("string").alias(c) for c in SNAPSHOTS.names if c not in ("capacity_key", "ts")],
    )
    newest = dedup_latest_by_key(clean_snapshots(good).select(*SNAPSHOTS.names), [*ITEM, "ts"], [F.desc("cu_seconds_today")])
    return newest, failures


def process_batch(
    batch: DataFrame,
    number: int,
    store: WatchTables,
    capacities: DataFrame,
    work: DataFrame | None = None,
    state_ttl_days: int | None = None,
    started_at: dt.datetime | None = None,
) -> None:
    spark = batch.sparkSession
    started_at = started_at or dt.datetime.now().replace(microsecond=0)
    newest, failures = readable(batch, number, store, started_at.date())
    span = Observation(f"readings-{number}")
    day = F.to_date("ts")
    readings = materialize(newest.observe(span, F.min(day).alias("first"), F.max(day).alias("last")), "readings")
    first, final = span.get["first"], span.get["last"]
    if first is None:
        return
    store.write_snapshots(readings, number)
    last = store.load_last_readings(before=number)
    intervals = materialize(fresh_intervals(readings, last), "intervals")
    store.write_intervals(intervals, number)

    cadenced = with_cadence(policy_join(intervals, capacities))
    store.write_samples(day_samples(cadenced), number)
    lookback = max(lookback_classes(capacities), default=0)
    past = store.read_samples(first - lookback * DAY, final + DAY, before=number)
    scored = score_fresh(intervals, past, capacities)

    state = store.load_states(before=number)
    done = gate_history(scored, capacities, state)
    anomalies = materialize(done.anomalies.drop("policy", "sku", "cu_per_second"), "anomalies")
    judged = anomalies.join(capacities.select("capacity_key", "policy"), "capacity_key")
    listed = work if work is not None else spark.createDataFrame([], WORK)
    plan = store.not_yet_planned(planned_actions(judged), number, first, final + DAY)
    results = materialize(action_results(plan, listed), "action-results")
    store.write_actions(results, number)
    store.write_targets(action_targets(plan, listed), number)
    full = with_results(judged, results)
    store.write_events(event_projection(full, F.lit(f"batch-{number}")), number)
    store.write_alerts(alert_outbox(full), number)

    summaries = run_summary(readings, cadenced, anomalies, action_taken(results), capacities)
    store.write_runs(run_log(summaries, failures, capacities, f"batch-{number}", started_at), number)
    store.save_states(final_state(done.verdicts, state), number, ttl_days=state_ttl_days)
    store.save_last_readings(readings, number)


def refold(store: WatchTables, capacities: DataFrame, since: dt.date, until: dt.date, batch: int) -> None:
    """Fold the stored intervals of a period anew, after settings that samples depend on have
    changed; samples under other settings do not count. `batch` is a number of its own below zero."""
    stored = store.read_intervals(since, until).select(*INTERVALS.names)
    fresh = day_samples(with_cadence(policy_join(stored, capacities)))
    known = store.read_samples(since, until).select("capacity_key", "basis", "day").distinct()
    store.write_samples(fresh.join(known, ["capacity_key", "basis", "day"], "left_anti"), batch)


def watch(
    snapshots: DataFrame,
    store: WatchTables,
    capacities: DataFrame,
    checkpoint: str,
    work: DataFrame | None = None,
    state_ttl_days: int | None = None,
) -> DataStreamWriter:
    """Writer over a stream of readings; choose a trigger and start it."""

    def run(batch: DataFrame, number: int) -> None:
        process_batch(batch, number, store, capacities, work, state_ttl_days)

    return snapshots.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
