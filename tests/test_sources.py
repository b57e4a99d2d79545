import datetime as dt

import pytest
from pyspark.sql import functions as F

from surgeline.functions.calendar import local_clock, naive, seconds_between
from surgeline.sources.columns import (
    clean_snapshots,
    pick_alias_profile,
    quarantine_snapshots,
    resolve_column,
    standardize_snapshots,
    METRICS_ALIASES,
)


@pytest.mark.parametrize(
    "name, canonical",
    [
        ("Items[ItemId]", "item_id"),
        ("itemsitemid", "item_id"),
        ("[cu_seconds_today]", "cu_seconds_today"),
        ("CU_SECONDS_TODAY", "cu_seconds_today"),
        ("[item_kind]", "item_kind"),
        ("Workspace_Name", "workspace_name"),
        ("Items[Other]", None),
    ],
)
def test_column_names(name, canonical):
    assert resolve_column(name, METRICS_ALIASES) == canonical


def test_unknown_columns_go(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Items[ItemId]", "junk", "when"])
    assert standardize_snapshots(df, keep=["when"]).columns == ["item_id", "when"]


def test_profiles():
    tables = ["items", "CAPACITIES", "metricsbyitemandoperationandday", "TimePoints"]
    both = ["Items[ItemId]", "Capacities[capacityId]"]
    day = ["MetricsByItemandOperationandDay[Date]"]
    full = both + day + ["Items[WorkspaceId]", "MetricsByItemandOperationandDay[sum_CU]"]
    assert pick_alias_profile(tables, full).name == "fabric_metrics_v1"
    assert pick_alias_profile(tables, both + day).name == "fabric_metrics_v2"
    assert pick_alias_profile(tables, both + ["timepoints[date]"]).name == "fabric_metrics_timepoints"
    assert pick_alias_profile(tables, both) is None


def test_cleaning(spark):
    rows = [
        ("a", "A", "Dataset", "w", "W", "1.5"),
        ("b", "", None, None, "", None),
        ("c", None, "", "w", None, ""),
        ("", "x", "x", "x", "x", "1"),
        (None, "x", "x", "x", "x", "1"),
        ("d", "D", "x", "x", "x", "n/a"),
    ]
    df = spark.createDataFrame(rows, "item_id string, item_name string, item_kind string, workspace_id string, workspace_name string, cu_seconds_today string")
    kept = {r.item_id: tuple(r)[1:] for r in clean_snapshots(df).collect()}
    assert kept == {
        "a": ("A", "Dataset", "w", "W", 1.5),
        "b": ("b", "Unknown", "", "", 0.0),
        "c": ("c", "Unknown", "w", "", 0.0),
    }
    assert quarantine_snapshots(df).count() == 3


def test_clock(spark):
    utc = naive(dt.datetime(2026, 1, 15, 12, 30, 15, 900000))
    row = spark.range(1).select(
        local_clock(utc, "America/Sao_Paulo").alias("local"),
        local_clock(utc, "Nowhere/Land").alias("unknown"),
        local_clock(utc, None).alias("none"),
    ).first()
    assert row.local == dt.datetime(2026, 1, 15, 9, 30, 15)
    assert row.unknown == row.none == dt.datetime(2026, 1, 15, 12, 30, 15)


def test_durations_ignore_the_session_zone(spark):
    """An hour that the session's zone skips is still an hour of naive time."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2026-03-29 01:30:00", "2026-03-29 03:30:00"))
        assert spark.range(1).select(seconds_between(a, b).alias("s")).first().s == 7200.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_naive_literals_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        moment = dt.datetime(2026, 1, 15, 12, 30)
        assert spark.range(1).select(naive(moment).alias("t")).first().t == moment
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_usage_is_neither_rounded_nor_lost_over_a_rename(spark):
    from surgeline.sources.usage import cumulative_snapshots, daily_cumulative

    rows = [(dt.datetime(2030, 5, 6, 9, m), "north", "n-1", "i", name, "Report", "t", "Team", cu) for m, name, cu in ((5, "old", 5.0), (40, "new", 7.004))]
    usage = spark.createDataFrame(
        rows,
        "ts timestamp_ntz, capacity_key string, capacity_id string, item_id string, item_name string, item_kind string,"
        " workspace_id string, workspace_name string, cu_seconds double",
    )
    for df in (cumulative_snapshots(usage), daily_cumulative(usage)):
        assert [(r.item_name, round(r.cu_seconds_today, 6)) for r in df.collect()] == [("new", 12.004)]
