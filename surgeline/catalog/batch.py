"""Batch operators as queries. Each takes the session and the folder of the given tables."""

from __future__ import annotations

import datetime as dt
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cadence import is_comparable, normalize
from ..functions.calendar import bucket_key, calendar_parts, local_clock, minutes_between, naive
from ..functions.robust import mean_of, median_of, quantile_of, trim_top
from ..functions.tiers import ALERT, NONE, is_suppressed, tier_label, trustworthy
from ..operators import baselines as bl
from ..operators import calibrate as cal
from ..operators import detect, intervals as iv, legacy, outbox, report
from ..operators import snapshots as sn
from ..operators.ranks import percentile_nearest
from ..plans.calibration import calibrate as run_calibration
from ..plans.cycle import run_cycle
from ..plans.replay import final_state, gate_history, score_history
from ..policy import (
    enabled_capacities,
    policy_join,
    sku_capacity,
    validate_policies,
)
from ..schemas import CYCLE, ITEM
from ..session import materialize, scratch_path
from ..sources import columns as cols
from ..sources import tables as tb
from ..sources import usage as us
from . import fixture as fx

QUERIES = {}

# The moments reports look from, inside the period the tables cover.
LAST_DAY = dt.date(2024, 1, 30)
REPORT_FROM = dt.datetime(2024, 1, 10)
PRUNE_BEFORE = dt.datetime(2024, 1, 12, 12)
ZONE = "America/Sao_Paulo"

ROW = [*ITEM, "window_end"]


def query(f):
    """Register under the function's name; a trailing underscore only avoids a clash. Dates are
    shown as text, so that results compare alike in every client."""

    @wraps(f)
    def shown(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        dates = [c.name for c in df.schema.fields if c.dataType.typeName() == "date"]
        return df.withColumns({name: F.col(name).cast("string") for name in dates})

    QUERIES[f.__name__.rstrip("_")] = shown
    return f


def r6(column: Column | str, name: str) -> Column:
    return F.round(column, 6).alias(name)


def joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


# -- shared inputs


def _cadenced(spark, d) -> DataFrame:
    return iv.with_cadence(policy_join(fx.intervals(spark, d), fx.capacities(spark)))


def _scored(spark, d, policies=None) -> DataFrame:
    policies = policies or fx.policy_set()
    return score_history(fx.snapshots(spark, d), fx.capacities(spark, policies))


def _given_state(scored: DataFrame) -> DataFrame:
    """A prior state for every row: a last action 90 or 200 minutes ago, or none."""
    hour, end = F.hour("window_end"), F.col("window_end")
    last = F.when(hour % 3 == 0, end - F.expr("INTERVAL 90 MINUTES")).when(
        hour % 3 == 1, end - F.expr("INTERVAL 200 MINUTES")
    )
    return scored.withColumn("streak", (hour % 2).cast("int")).withColumn("last_action_ts", last)


def _assessed(spark, d) -> DataFrame:
    return detect.assess(_given_state(_scored(spark, d)))


def _gated(spark, d) -> DataFrame:
    """Assessed rows after both cycle gates, written once because gates read them twice."""
    attached = ["policy", "sku", "cu_per_second"]
    stored = materialize(_assessed(spark, d).drop(*attached), "assessed")
    return detect.cycle_gates(policy_join(stored, fx.capacities(spark)))


def _state(scored: DataFrame) -> DataFrame:
    """An item state as earlier cycles could have left it."""
    return scored.groupBy(*ITEM).agg(
        (F.count_if(F.col("tier") > NONE) % 3).cast("int").alias("streak"),
        F.lit("alert").alias("last_tier"),
        F.max(F.when(F.col("tier") > ALERT, F.col("window_end"))).alias("last_action_ts"),
        F.max("window_end").alias("last_seen_ts"),
    )


def _results(spark, d) -> tuple[DataFrame, DataFrame]:
    anomalies = _gated(spark, d).filter(F.col("tier") > NONE)
    return anomalies, outbox.action_results(outbox.planned_actions(anomalies), fx.work(spark, d))


def _full(spark, d) -> DataFrame:
    anomalies, results = _results(spark, d)
    return outbox.with_results(anomalies, results)


def _events(spark, d) -> DataFrame:
    return outbox.event_projection(_full(spark, d), F.lit("run-1"))


def _show_events(events: DataFrame) -> DataFrame:
    return events.select(
        "ts", "run_id", "capacity_key", "mode", "item_id", "item_name", "item_kind", "workspace_id",
        "tier", "effective_tier", r6("ratio", "ratio"), r6("cu_seconds", "cu_seconds"),
        r6("baseline_cu_seconds", "baseline_cu_seconds"), "baseline_days", "streak", "suppressions",
        "actions", "detail",
    )


def _show_intervals(df: DataFrame) -> DataFrame:
    return df.select(
        *ITEM, "item_name", "item_kind", "workspace_id", "workspace_name", "window_start", "window_end",
        r6("cu_seconds", "cu_seconds"),
    )


def _show_snapshots(df: DataFrame) -> DataFrame:
    return df.select(
        "ts", "capacity_key", "capacity_id", "item_id", "item_name", "item_kind", "workspace_id",
        "workspace_name", "cu_seconds_today",
    )


def _show_verdicts(df: DataFrame) -> DataFrame:
    return df.select(
        *ROW, r6("ratio", "ratio"), "tier", "effective_tier", "streak", joined("suppressions")
    )


# -- sources, sinks, table maintenance


@query
def daily_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return us.daily_cumulative(fx.usage(spark, d)).withColumn("cu_seconds_today", F.round("cu_seconds_today", 2))


@query
def cumulative_snapshots(spark, d):
    return _show_snapshots(fx.snapshots(spark, d))


def _foreign(spark, d) -> DataFrame:
    """Snapshots under the column names of a metrics model, in mixed spellings."""
    return fx.snapshots(spark, d).select(
        "ts",
        "capacity_key",
        F.col("item_id").alias("Items[ItemId]"),
        F.col("item_name").alias("items[itemname]"),
        F.col("item_kind").alias("[ITEM_KIND]"),
        F.col("workspace_id").alias("ItemsWorkspaceId"),
        F.col("workspace_name").alias("Items[WorkspaceName]"),
        F.col("cu_seconds_today").alias("[cu_seconds_today]"),
        F.lit("x").alias("Items[Unrelated]"),
    )


@query
def standardize_snapshots(spark, d):
    return cols.standardize_snapshots(_foreign(spark, d), keep=["ts", "capacity_key"])


def _dirty(spark, d) -> DataFrame:
    """Events as unclean readings: blanks and unreadable numbers by the hour of the event."""
    minute = F.minute("ts")
    return fx.table(spark, d, "events").select(
        "event_id",
        F.when(minute % 10 == 0, "").when(minute % 10 == 1, F.lit(None)).otherwise(F.col("event_type")).alias("item_id"),
        F.when(minute % 4 == 0, "").otherwise(F.concat(F.lit("Name "), "event_type")).alias("item_name"),
        F.when(minute % 5 == 0, F.lit(None)).otherwise(F.lit("Dataset")).alias("item_kind"),
        F.when(minute % 6 == 0, F.lit(None)).otherwise(F.lit("ws-1")).alias("workspace_id"),
        F.lit(None).cast("string").alias("workspace_name"),
        F.when(minute % 7 == 0, "n/a")
        .when(minute % 7 == 1, F.lit(None))
        .when(minute % 7 == 2, "")
        .otherwise(F.col("value").cast("string"))
        .alias("cu_seconds_today"),
    )


@query
def clean_snapshots(spark, d):
    return cols.clean_snapshots(_dirty(spark, d))


@query
def pick_alias_profile(spark, d):
    """Pick the layout by the columns present, then read through it."""
    foreign = _foreign(spark, d)
    present = ["Items[ItemId]", "Capacities[capacityId]", "metricsbyitemandoperationandday[DATE]"]
    profile = cols.pick_alias_profile(["items", "capacities", "MetricsByItemAndOperationAndDay"], present)
    read = cols.standardize_snapshots(foreign, profile.aliases, keep=["ts", "capacity_key"])
    return read.groupBy("capacity_key", "item_id").agg(
        F.count("*").alias("readings"), F.lit(profile.name).alias("profile")
    )


@query
def union_capacities(spark, d):
    all_usage = fx.usage(spark, d)
    frames = {
        key: all_usage.filter(F.col("capacity_key") == key).drop("capacity_key") for key in ("C0", "C1", "C2")
    }
    stacked = cols.union_capacities(frames)
    return stacked.select("capacity_key", "item_id", "ts", *calendar_parts(F.col("ts")), "cu_seconds")


def _tables(spark) -> tb.WatchTables:
    return tb.WatchTables(spark, scratch_path(spark, "watch"))


@query
def write_snapshots(spark, d):
    """Two overlapping batches; the later one wins where both have a reading."""
    store, rows = _tables(spark), fx.snapshots(spark, d)
    store.write_snapshots(rows, 0)
    evening = rows.filter(F.hour("ts") >= 12).withColumn("cu_seconds_today", F.col("cu_seconds_today") + 1)
    store.write_snapshots(evening, 1)
    return _show_snapshots(store.read_snapshots())


@query
def dedup_latest_by_key(spark, d):
    """Last reading per item and day."""
    rows = fx.snapshots(spark, d).withColumn("day", F.to_date("ts"))
    return sn.dedup_latest_by_key(rows, [*ITEM, "day"], [F.desc("ts")]).select(
        *ITEM, "day", "ts", "cu_seconds_today"
    )


@query
def write_intervals(spark, d):
    store = _tables(spark)
    store.write_intervals(fx.intervals(spark, d), 0)
    store.write_intervals(fx.intervals(spark, d), 0)
    kept = store.read_intervals(dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    return kept.select(*ROW, r6("cu_seconds", "cu_seconds"), "day", "hour", "dow")


@query
def load_intervals(spark, d):
    store = _tables(spark)
    store.write_intervals(fx.intervals(spark, d), 0)
    kept = store.read_intervals(dt.date(2024, 1, 9), dt.date(2024, 1, 16), "C1", [8, 14, 20])
    return kept.select(*ROW, r6("cu_seconds", "cu_seconds"), "day", "hour", "dow")


@query
def write_events(spark, d):
    store = _tables(spark)
    store.write_events(_events(spark, d), 0)
    return _show_events(store.read_events())


@query
def load_events(spark, d):
    return _show_events(report.load_events(_events(spark, d), REPORT_FROM, "C0"))


@query
def load_states(spark, d):
    store = _tables(spark)
    store.save_states(_state(_scored(spark, d)), 0)
    return store.load_states()


def _changes(scored: DataFrame) -> DataFrame:
    """New state for the datasets among the items, seen a day later."""
    return _state(scored.filter(F.col("item_kind").isin("Dataset", "SemanticModel"))).select(
        *ITEM,
        (F.col("streak") + 10).alias("streak"),
        F.lit("kill").alias("last_tier"),
        F.lit(None).cast("timestamp_ntz").alias("last_action_ts"),
        (F.col("last_seen_ts") + F.expr("INTERVAL 1 DAY")).alias("last_seen_ts"),
    )


@query
def merge_states(spark, d):
    store, scored = _tables(spark), _scored(spark, d)
    store.save_states(_state(scored), 0)
    store.save_states(_changes(scored), 1)
    return store.load_states()


@query
def prune_snapshots(spark, d):
    store = _tables(spark)
    store.write_snapshots(fx.snapshots(spark, d), 0)
    store.prune_snapshots(PRUNE_BEFORE)
    store.prune_snapshots(PRUNE_BEFORE - dt.timedelta(days=3))  # an older cutoff brings nothing back
    return _show_snapshots(store.read_snapshots())


@query
def events_json(spark, d):
    """The events as JSON and back, so that the text itself is what is compared."""
    text = report.events_json(_events(spark, d))
    return text.select(
        F.get_json_object("json", "$.item_id").alias("item_id"),
        F.get_json_object("json", "$.capacity_key").alias("capacity_key"),
        F.get_json_object("json", "$.tier").alias("tier"),
        F.get_json_object("json", "$.suppressions").alias("suppressions"),
        F.get_json_object("json", "$.streak").cast("int").alias("streak"),
    )


@query
def collect_history_sql(spark, d):
    return report.collect_history_sql(
        spark,
        {"watch_intervals": fx.intervals(spark, d)},
        "SELECT capacity_key, item_id, window_end, round(cu_seconds, 6) AS cu_seconds FROM watch_intervals "
        "ORDER BY window_end DESC, capacity_key, item_id LIMIT 100",
    )


# -- filters and predicates


@query
def is_comparable_(spark, d):
    rows = _cadenced(spark, d)
    p = F.col("policy")
    return rows.select(
        *ROW,
        is_comparable(F.col("minutes"), p["interval_minutes"], p["guards"]["max_interval_stretch"]).alias("comparable"),
    )


@query
def enabled_capacities_(spark, d):
    active = enabled_capacities(fx.capacities(spark), ["C0", "C2", "C3"])
    return (
        fx.usage(spark, d)
        .join(active.select("capacity_key"), "capacity_key", "left_semi")
        .groupBy("capacity_key")
        .agg(F.count("*").alias("readings"), r6(F.sum("cu_seconds"), "cu_seconds"))
    )


@query
def is_protected(spark, d):
    rows = policy_join(fx.intervals(spark, d), fx.capacities(spark))
    return rows.select(*ROW, detect.is_protected(F.col("policy")["protect"]).alias("protected"))


@query
def freeze_window(spark, d):
    rows = policy_join(fx.intervals(spark, d), fx.capacities(spark))
    return rows.select(*ROW, detect.freeze_window(F.col("window_end"), F.col("policy")["freeze_windows"]).alias("frozen_by"))


@query
def min_tier_filter(spark, d):
    return outbox.min_tier_filter(_scored(spark, d)).select(*ROW, "channel", "tier")


@query
def legacy_anomaly_filter(spark, d):
    return _show_legacy(legacy.legacy_anomaly_filter(_legacy_scored(spark, d), 20.0))


@query
def running_refreshes(spark, d):
    return outbox.running_refreshes(fx.work(spark, d))


@query
def running_jobs(spark, d):
    return outbox.running_jobs(fx.work(spark, d))


def _legacy(spark, d) -> DataFrame:
    return legacy.legacy_intervals(fx.snapshots(spark, d))


def _legacy_scored(spark, d) -> DataFrame:
    return legacy.legacy_scored(_legacy(spark, d), F.lit(LAST_DAY))


def _show_legacy(df: DataFrame) -> DataFrame:
    return df.select(
        *ITEM, "ts", r6("cu_interval", "cu_interval"), r6("baseline_cu_s", "baseline_cu_s"), "baseline_days",
        r6("ratio", "ratio"),
    )


@query
def legacy_current(spark, d):
    return legacy.legacy_current(_legacy(spark, d), F.lit(LAST_DAY)).select(
        *ITEM, "ts", "hour_bucket", r6("cu_interval", "cu_interval")
    )


@query
def baseline_history_filter(spark, d):
    return bl.baseline_history(_cadenced(spark, d), F.lit(LAST_DAY)).select(*ROW, "bucket", r6("normalized", "normalized"))


# -- projections


@query
def bucket_key_(spark, d):
    rows = policy_join(fx.intervals(spark, d), fx.capacities(spark))
    return rows.select(*ROW, bucket_key(F.col("window_end"), F.col("policy")["baseline"]["bucket"]).alias("bucket"))


@query
def interval_minutes(spark, d):
    minutes = minutes_between(F.col("window_start"), F.col("window_end"))
    return fx.intervals(spark, d).select(*ROW, minutes.alias("minutes"))


@query
def normalize_(spark, d):
    minutes = minutes_between(F.col("window_start"), F.col("window_end"))
    rows = policy_join(fx.intervals(spark, d), fx.capacities(spark)).withColumn("minutes", minutes)
    normal = normalize(F.col("cu_seconds"), F.col("minutes"), F.col("policy")["interval_minutes"])
    return rows.select(*ROW, r6(normal, "normalized"))


@query
def trustworthy_(spark, d):
    return _scored(spark, d).select(*ROW, trustworthy(F.col("baseline")).alias("trustworthy"))


@query
def ratio(spark, d):
    return _scored(spark, d).select(*ROW, r6("ratio", "ratio"))


@query
def classify(spark, d):
    return _scored(spark, d).select(*ROW, "tier", tier_label(F.col("tier")).alias("label"))


@query
def sku_capacity_(spark, d):
    """Total use of each capacity next to what its SKU offers per second."""
    skus = sku_capacity(fx.capacities(spark).select("capacity_key", "sku"))
    used = fx.usage(spark, d).groupBy("capacity_key").agg(F.sum("cu_seconds").alias("_used"))
    return used.join(skus, "capacity_key").select("capacity_key", "sku", "cu_per_second", r6("_used", "cu_seconds"))


@query
def utilization_pct(spark, d):
    use = detect.utilization_pct(_cadenced(spark, d).filter("comparable"))
    return use.select(*CYCLE, r6("utilization", "utilization"))


@query
def local_clock_(spark, d):
    events = fx.table(spark, d, "events")
    return events.select("event_id", local_clock(F.col("ts").cast("timestamp_ntz"), ZONE).alias("local_ts"))


@query
def calendar_parts_(spark, d):
    return fx.intervals(spark, d).select(*ROW, *calendar_parts(F.col("window_end")))


@query
def event_projection(spark, d):
    return _show_events(_events(spark, d))


@query
def alert_text(spark, d):
    return _full(spark, d).select(*ROW, outbox.alert_text().alias("text"))


@query
def legacy_reset(spark, d):
    """Consecutive readings of one item over all days, so that each midnight is a reset."""
    pairs = sn.previous_reading(fx.snapshots(spark, d))
    used = legacy.legacy_reset(F.col("cu_seconds_today"), F.col("prev_cu"))
    return pairs.select(*ITEM, "ts", r6(used, "cu_interval"))


@query
def suppressed_flag(spark, d):
    return _assessed(spark, d).select(*ROW, is_suppressed(F.col("tier"), F.col("effective_tier")).alias("suppressed"))


# -- joins


@query
def previous_snapshot(spark, d):
    newest = sn.previous_snapshot(fx.snapshots(spark, d), naive(dt.datetime(2024, 1, 30, 12)))
    return _show_snapshots(newest)


@query
def readings_as_of(spark, d):
    """The reading that stood before each event, at the event's own time."""
    asked = fx.table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("capacity_key"),
        F.col("event_type").alias("item_id"),
        F.col("ts").cast("timestamp_ntz").alias("moment"),
    )
    return sn.readings_as_of(asked, fx.snapshots(spark, d)).select("event_id", *ITEM, "moment", "prev_ts", "prev_cu")


def _latest(spark, d) -> tuple[DataFrame, DataFrame]:
    """The readings of the last day's final cycle, and those before it."""
    rows = fx.snapshots(spark, d)
    moment = rows.agg(F.max("ts")).scalar()
    return rows.filter(F.col("ts") == moment), sn.previous_snapshot(rows, moment)


@query
def interval_pairing(spark, d):
    """Each reading paired with the item's last one of the day before."""
    rows = fx.snapshots(spark, d).withColumn("day", F.to_date("ts"))
    of_day = lambda day: F.concat("item_id", F.lit("@"), day.cast("string"))
    before = sn.dedup_latest_by_key(rows, [*ITEM, "day"], [F.desc("ts")])
    current, previous = rows.withColumn("item_id", of_day(F.col("day"))), before.withColumn("item_id", of_day(F.date_add("day", 1)))
    intervals = iv.intervals_from_pairs(iv.interval_pairing(current, previous))
    return _show_intervals(intervals.withColumn("item_id", F.substring_index("item_id", "@", 1)))


@query
def baseline_join(spark, d):
    """All comparable intervals against the baselines of the whole period's last day."""
    rows = _cadenced(spark, d).filter("comparable")
    baselines = bl.compute_baselines(bl.baseline_history(rows, F.lit(LAST_DAY)), fx.capacities(spark))
    return bl.baseline_join(rows, baselines).select(*ROW, r6(F.col("baseline.value"), "baseline"))


@query
def state_join(spark, d):
    scored = _scored(spark, d)
    return detect.state_join(scored.select(*ROW), _state(scored)).select(*ROW, "streak", "last_action_ts")


@query
def policy_join_(spark, d):
    rows = policy_join(fx.snapshots(spark, d), fx.capacities(spark))
    p = F.col("policy")
    return rows.select(
        *ITEM, "ts", p["mode"].alias("mode"), p["thresholds"]["alert"].alias("alert"), p["baseline"]["method"].alias("method")
    )


@query
def history_range_join(spark, d):
    """Every interval with the size and sum of its own history band."""
    scored = _scored(spark, d)
    b = F.col("baseline")
    return scored.select(*ROW, F.coalesce(b["samples"], F.lit(0)).alias("samples"), F.coalesce(b["days"], F.lit(0)).alias("days"))


@query
def semi_capacity(spark, d):
    wanted = fx.capacities(spark).filter(F.col("capacity_key").isin("C1", "C2", "C3"))
    return us.semi_capacity(fx.usage(spark, d), wanted).groupBy("capacity_id", "item_id").agg(F.count("*").alias("readings"))


@query
def unmatched_capacities(spark, d):
    return sn.unmatched_capacities(fx.capacities(spark), fx.usage(spark, d)).select("capacity_key", "capacity_id")


@query
def action_targets(spark, d):
    plan = outbox.planned_actions(_gated(spark, d))
    return outbox.action_targets(plan, fx.work(spark, d)).select(*ROW, "action", "target")


# -- aggregations


def _show_baseline(df: DataFrame) -> DataFrame:
    b = F.col("baseline")
    return df.select(*ITEM, "bucket", r6(b["value"], "value"), b["days"].alias("days"), b["samples"].alias("samples"), b["method"].alias("method"))


@query
def compute_baselines(spark, d):
    """Baselines as the last day sees them, for every bucket."""
    history = bl.baseline_history(_cadenced(spark, d), F.lit(LAST_DAY))
    return _show_baseline(bl.compute_baselines(history, fx.capacities(spark)))


def _sorted_samples(spark, d) -> DataFrame:
    """All comparable samples of each item and hour, ascending; at most one per hour and day."""
    rows = _cadenced(spark, d).filter("comparable").withColumn("hour", F.hour("window_end"))
    return rows.groupBy(*ITEM, "hour").agg(F.sort_array(F.collect_list("normalized")).alias("samples"))


@query
def trim_top_(spark, d):
    kept = trim_top(F.col("samples"), F.lit(25.0))
    rows = _sorted_samples(spark, d).withColumn("kept", kept)
    return rows.select(*ITEM, "hour", F.size("kept").alias("kept"), r6(F.array_max("kept"), "highest"))


@query
def agg_mean(spark, d):
    return _sorted_samples(spark, d).select(*ITEM, "hour", F.round(mean_of(F.col("samples")), 9).alias("value"))


@query
def agg_median(spark, d):
    return _sorted_samples(spark, d).select(*ITEM, "hour", r6(median_of(F.col("samples")), "value"))


@query
def agg_p75(spark, d):
    return _sorted_samples(spark, d).select(*ITEM, "hour", r6(quantile_of(F.col("samples"), 0.75), "value"))


@query
def agg_p90(spark, d):
    return _sorted_samples(spark, d).select(*ITEM, "hour", r6(quantile_of(F.col("samples"), 0.90), "value"))


@query
def percentile_nearest_(spark, d):
    """Over every line of the daily log, per capacity: groups grow with the table."""
    ranks = percentile_nearest(
        fx.daily_usage(spark, d), ["capacity_key"], "cu_seconds", {"p50": 0.5, "p95": 0.95, "p995": 0.995}
    )
    return ranks.withColumnRenamed("n", "lines")


@query
def capacity_total(spark, d):
    return iv.capacity_total(_cadenced(spark, d).filter("comparable")).select(*CYCLE, r6("cu_seconds", "cu_seconds"))


@query
def latest_per_item(spark, d):
    return _show_snapshots(sn.latest_per_item(fx.snapshots(spark, d)))


@query
def legacy_baseline(spark, d):
    return legacy.legacy_baseline(_legacy(spark, d), F.lit(LAST_DAY)).select(
        *ITEM, "hour_bucket", r6("baseline_cu_s", "baseline_cu_s"), "baseline_days"
    )


@query
def latest_ts(spark, d):
    return legacy.latest_ts(_legacy(spark, d), F.lit(LAST_DAY))


def _calibration_rows(spark, d) -> DataFrame:
    """The scored history, written once for the statistics that read it several times."""
    stored = materialize(_scored(spark, d).drop("policy", "sku", "cu_per_second"), "scored")
    return policy_join(stored, fx.capacities(spark))


def _show_profiles(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        *ITEM, "item_name", "item_kind", "samples", r6("median_cu", "median_cu"), r6("p95_cu", "p95_cu"),
        r6("max_ratio", "max_ratio"), "alert", "throttle", "kill", *more,
    )


@query
def item_profile(spark, d):
    return _show_profiles(cal.item_profile(_calibration_rows(spark, d)))


@query
def would_counts(spark, d):
    return report.would_counts(cal.usable_ratios(_scored(spark, d)))


@query
def suggest_thresholds(spark, d):
    usable = cal.usable_ratios(_calibration_rows(spark, d))
    return cal.suggest_thresholds(usable, fx.capacities(spark))


@query
def suggest_min_cu(spark, d):
    return cal.suggest_min_cu(_calibration_rows(spark, d))


@query
def days_seen(spark, d):
    return cal.days_seen(_scored(spark, d))


@query
def events_by_tier(spark, d):
    return report.events_by_tier(_events(spark, d))


@query
def run_summary(spark, d):
    anomalies, results = _results(spark, d)
    taken = outbox.action_taken(results)
    return report.run_summary(fx.snapshots(spark, d), _cadenced(spark, d), anomalies, taken, fx.capacities(spark))


@query
def enforce_readiness(spark, d):
    return report.enforce_readiness(fx.capacities(spark), fx.intervals(spark, d), LAST_DAY)


@query
def action_taken(spark, d):
    return outbox.action_taken(_results(spark, d)[1])


@query
def discard_count(spark, d):
    return iv.discard_count(_cadenced(spark, d))


@query
def empty_history_report(spark, d):
    policies = fx.policy_set()
    history = materialize(fx.intervals(spark, d), "intervals")
    done = run_calibration(history, fx.capacities(spark))
    return done.report.select(
        "capacity_key", "days_of_history", "total_intervals", "would_alert", "would_throttle", "would_kill",
        "suggested_alert", "suggested_throttle", "suggested_kill", "suggested_min_cu",
        joined("noisy_items"), joined("notes"),
    )


# -- windows


@query
def derive_intervals(spark, d):
    return _show_intervals(fx.intervals(spark, d))


@query
def derive_intervals_daily(spark, d):
    return _show_intervals(fx.daily_intervals(spark, d))


@query
def legacy_intervals(spark, d):
    return _legacy(spark, d).select(*ITEM, "ts", "date", "hour_bucket", r6("cu_interval", "cu_interval"))


@query
def latest_row_number(spark, d):
    return _show_snapshots(sn.latest_row_number(fx.snapshots(spark, d)))


@query
def streak(spark, d):
    stored = materialize(_scored(spark, d).select(*ROW, "tier"), "tiers")
    return detect.with_streak(stored).select(*ROW, "tier", "streak")


@query
def replay_baselines(spark, d):
    b = F.col("baseline")
    return _scored(spark, d).select(
        *ROW,
        "bucket",
        r6(b["value"], "value"),
        F.coalesce(b["days"], F.lit(0)).alias("days"),
        F.coalesce(b["samples"], F.lit(0)).alias("samples"),
    )


def _daily_scored(spark, d) -> DataFrame:
    policies = fx.daily_set()
    return score_history(fx.daily_snapshots(spark, d), fx.capacities(spark, policies), "year")


@query
def replay_baselines_daily(spark, d):
    b = F.col("baseline")
    return _daily_scored(spark, d).select(*ROW, r6(b["value"], "value"), F.coalesce(b["days"], F.lit(0)).alias("days"), "tier")


@query
def distinct_days_in_frame(spark, d):
    return _scored(spark, d).select(*ROW, F.coalesce(F.col("baseline.days"), F.lit(0)).alias("days"))


@query
def cooldown(spark, d):
    rows = _given_state(_scored(spark, d))
    held = detect.in_cooldown(F.col("window_end"), F.col("last_action_ts"), F.col("policy")["guards"]["cooldown_minutes"])
    return rows.select(*ROW, held.alias("in_cooldown"))


@query
def run_budget(spark, d):
    stored = materialize(_assessed(spark, d).drop("policy", "sku", "cu_per_second"), "assessed")
    return _show_verdicts(detect.run_budget(policy_join(stored, fx.capacities(spark))))


@query
def capacity_guard(spark, d):
    stored = materialize(_assessed(spark, d).drop("policy", "sku", "cu_per_second"), "assessed")
    return _show_verdicts(detect.capacity_guard(policy_join(stored, fx.capacities(spark))))


# -- gates


@query
def assess(spark, d):
    return _show_verdicts(_assessed(spark, d))


@query
def cycle_gates(spark, d):
    return _show_verdicts(_gated(spark, d))


@query
def advance_state(spark, d):
    """The state each row would leave, were its cycle the current one."""
    return detect.advance_state(_gated(spark, d)).select(*ITEM, "streak", "last_tier", "last_action_ts", "last_seen_ts")


@query
def planned_actions(spark, d):
    return outbox.planned_actions(_gated(spark, d)).select(*ROW, "step", "action", "ok", "refused")


@query
def alert_outbox(spark, d):
    return outbox.alert_outbox(_full(spark, d)).select(*ROW, "channel", "text")


@query
def legacy_escalation(spark, d):
    rows = legacy.legacy_anomaly_filter(_legacy_scored(spark, d), 0.0)
    levels = legacy.legacy_escalation(rows, "ENFORCE", ["error"])
    return levels.select(*ITEM, "ts", "level", "action", "mode", r6("ratio", "ratio"))


@query
def resolve_policies(spark, d):
    """Effective settings, next to how many readings they apply to."""
    counts = fx.usage(spark, d).groupBy("capacity_key").agg(F.count("*").alias("readings"))
    p = F.col("policy")
    return counts.join(fx.capacities(spark), "capacity_key").select(
        "capacity_key",
        "readings",
        p["mode"].alias("mode"),
        p["thresholds"]["alert"].alias("alert"),
        p["thresholds"]["kill"].alias("kill"),
        p["baseline"]["method"].alias("method"),
        p["baseline"]["min_days"].alias("min_days"),
        p["guards"]["max_actions_per_run"].alias("max_actions"),
        p["guards"]["consecutive_breaches"].alias("breaches"),
    )


@query
def validate_policies_(spark, d):
    """Policies whose numbers come from the data: each capacity's extreme hour as its settings."""
    use = fx.usage(spark, d).groupBy("capacity_key").agg(
        F.max("cu_seconds").alias("_top"), F.count_distinct(F.to_date("ts")).alias("_days")
    )
    p = F.col("policy")
    steps = p["thresholds"].withField("alert", F.col("_top") / 100.0)
    rules = p["baseline"].withField("lookback_days", (F.col("_days") * 4).cast("int")).withField("trim_top_percent", F.col("_top") / 10)
    changed = fx.capacities(spark).join(use, "capacity_key").withColumn(
        "policy", p.withField("thresholds", steps).withField("baseline", rules)
    )
    return validate_policies(changed)


# -- sorts, limits


@query
def rank_assessments(spark, d):
    return _show_verdicts(report.rank_assessments(_assessed(spark, d)))


@query
def top_consumers(spark, d):
    rows = us.daily_cumulative(fx.usage(spark, d)).withColumn("cu_seconds_today", F.round("cu_seconds_today", 2))
    return sn.top_consumers(rows, ["capacity_key", "day"], 3).select("capacity_key", "day", "item_id", "cu_seconds_today", "rank")


@query
def rank_profiles(spark, d):
    return _show_profiles(cal.rank_profiles(cal.item_profile(_calibration_rows(spark, d))), "rank")


@query
def noisy_items(spark, d):
    found = cal.noisy_items(cal.item_profile(_calibration_rows(spark, d)))
    return found.select("capacity_key", joined("noisy_items"))


@query
def recent_events(spark, d):
    return _show_events(report.recent_events(_events(spark, d)))


@query
def legacy_scored(spark, d):
    return _show_legacy(_legacy_scored(spark, d))


# -- whole plans


@query
def calibrate_daily(spark, d):
    """Calibration of the daily log, whose items grow with the table."""
    policies = fx.daily_set()
    history = materialize(fx.daily_intervals(spark, d), "intervals")
    done = run_calibration(history, fx.capacities(spark, policies))
    return done.report.select(
        "capacity_key", "days_of_history", "total_intervals", "would_alert", "would_throttle", "would_kill",
        "suggested_alert", "suggested_throttle", "suggested_kill", "suggested_min_cu", joined("noisy_items"),
    )


@query
def replay_gates(spark, d):
    """All cycles with streak, cooldown and budget carried from one to the next."""
    policies = fx.policy_set()
    caps = fx.capacities(spark)
    done = gate_history(score_history(fx.snapshots(spark, d), caps), caps)
    return _show_verdicts(done.anomalies)


@query
def replay_state(spark, d):
    policies = fx.policy_set()
    caps = fx.capacities(spark)
    done = gate_history(score_history(fx.snapshots(spark, d), caps), caps)
    return final_state(done.verdicts)


@query
def cycle_events(spark, d):
    """The events of the last cycle."""
    current, previous = _latest(spark, d)
    history = fx.intervals(spark, d)
    done = run_cycle(
        current, previous, history, _state(_scored(spark, d)), fx.capacities(spark), fx.work(spark, d), F.lit("run-1")
    )
    return _show_verdicts(done.assessed)

