"""Explicit schemas of the tables. All times are naive local (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM = ["capacity_key", "item_id"]
CYCLE = ["capacity_key", "window_end"]
ATTRIBUTES = ["item_name", "item_kind", "workspace_id", "workspace_name"]

TEXT, NUMBER, WHOLE, FLAG, TIME = (
    T.StringType(),
    T.DoubleType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)
TEXTS, WHOLES = T.ArrayType(TEXT), T.ArrayType(WHOLE)


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_ATTRIBUTE_FIELDS = {name: TEXT for name in ATTRIBUTES}

USAGE = record(
    ts=TIME, capacity_key=TEXT, capacity_id=TEXT, item_id=TEXT, **_ATTRIBUTE_FIELDS, cu_seconds=NUMBER
)

SNAPSHOTS = record(
    ts=TIME, capacity_key=TEXT, capacity_id=TEXT, item_id=TEXT, **_ATTRIBUTE_FIELDS, cu_seconds_today=NUMBER
)

INTERVALS = record(
    capacity_key=TEXT, item_id=TEXT, **_ATTRIBUTE_FIELDS, window_start=TIME, window_end=TIME, cu_seconds=NUMBER
)

ITEM_STATE = record(
    capacity_key=TEXT, item_id=TEXT, streak=WHOLE, last_tier=TEXT, last_action_ts=TIME, last_seen_ts=TIME
)

EVENTS = record(
    ts=TIME,
    run_id=TEXT,
    capacity_key=TEXT,
    mode=TEXT,
    item_id=TEXT,
    item_name=TEXT,
    item_kind=TEXT,
    workspace_id=TEXT,
    tier=TEXT,
    effective_tier=TEXT,
    ratio=NUMBER,
    cu_seconds=NUMBER,
    baseline_cu_seconds=NUMBER,
    baseline_days=WHOLE,
    streak=WHOLE,
    suppressions=TEXT,
    actions=TEXT,
    detail=TEXT,
)

ALERTS = record(capacity_key=TEXT, item_id=TEXT, window_end=TIME, channel=TEXT, tier=WHOLE, text=TEXT)

SAMPLES = record(capacity_key=TEXT, item_id=TEXT, bucket=TEXT, basis=TEXT, samples=T.ArrayType(record(at=TIME, value=NUMBER)))

ACTIONS = record(
    capacity_key=TEXT, item_id=TEXT, window_end=TIME, step=WHOLE, action=TEXT, ok=FLAG, detail=TEXT, targets=T.LongType()
)
TARGETS = record(capacity_key=TEXT, item_id=TEXT, window_end=TIME, step=WHOLE, action=TEXT, target=TEXT)

RUNS = record(
    run_id=TEXT,
    started_at=TIME,
    capacity_key=TEXT,
    mode=TEXT,
    window_end=TIME,
    items_scanned=T.LongType(),
    anomalies=T.LongType(),
    actions_taken=T.LongType(),
    skipped_intervals=T.LongType(),
    bootstrap=FLAG,
    errors=T.LongType(),
)
QUARANTINE = record(capacity_key=TEXT, reason=TEXT, row=TEXT)
FAILURES = record(capacity_key=TEXT, reason=TEXT, rows=T.LongType(), readable=T.LongType())

FREEZE_WINDOW = record(name=TEXT, days=WHOLES, start_hour=WHOLE, end_hour=WHOLE, days_of_month=WHOLES)
CHANNEL = record(kind=TEXT, url=TEXT, min_tier=TEXT, timeout_seconds=WHOLE)

POLICY = record(
    mode=TEXT,
    interval_minutes=WHOLE,
    baseline=record(
        lookback_days=WHOLE, bucket=TEXT, min_days=WHOLE, method=TEXT, trim_top_percent=NUMBER
    ),
    thresholds=record(alert=NUMBER, throttle=NUMBER, kill=NUMBER),
    guards=record(
        min_cu_seconds=NUMBER,
        consecutive_breaches=WHOLE,
        cooldown_minutes=WHOLE,
        max_actions_per_run=WHOLE,
        max_interval_stretch=NUMBER,
        min_capacity_utilization_percent=NUMBER,
    ),
    actions=record(alert=TEXTS, throttle=TEXTS, kill=TEXTS),
    protect=record(item_ids=TEXTS, workspace_ids=TEXTS, item_kinds=TEXTS, name_patterns=TEXTS),
    freeze_windows=T.ArrayType(FREEZE_WINDOW),
    notify=T.ArrayType(CHANNEL),
)

CAPACITIES = record(
    capacity_key=TEXT, capacity_id=TEXT, enabled=FLAG, sku=TEXT, cu_per_second=NUMBER, policy=POLICY
)
