"""What the optimizer makes of the operators: the properties they rely on at scale."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from surgeline.operators.baselines import replay_baselines
from surgeline.operators.calibrate import READ, item_profile
from surgeline.operators.detect import assess, cycle_gates
from surgeline.operators.intervals import derive_intervals, with_cadence
from surgeline.operators.ranks import percentile_nearest
from surgeline.operators.snapshots import dedup_latest_by_key, latest_per_item, top_consumers
from surgeline.plans.calibration import calibrate
from surgeline.plans.replay import score_history
from surgeline.policy import policy_join
from surgeline.schemas import ITEM, USAGE
from surgeline.sources.usage import cumulative_snapshots

T0 = dt.datetime(2029, 8, 1)


@pytest.fixture
def stored(make, spark, tmp_path):
    """Readings in a file, so that statistics are real and scans show."""
    path = str(tmp_path / "snapshots")
    times = [T0 + dt.timedelta(hours=n) for n in range(100)]
    make.snapshots(*[(i, t, n) for i in "ab" for n, t in enumerate(times)]).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def window_keys(text):
    """Partition columns of every window in a plan."""
    return [re.sub(r"#\d+L?", "", m).split(", ") for m in re.findall(r"Window \[.*\], \[([^\]]*)\], \[[^\]]*\]\n", text)]


def test_ranked_rows_are_limited_before_the_shuffle(stored):
    for df in (
        dedup_latest_by_key(stored, [*ITEM, "ts"], [F.desc("cu_seconds_today")]),
        top_consumers(stored, ["capacity_key"], 3),
    ):
        text = plan(df)
        assert re.search(r"WindowGroupLimit .*Partial", text), text


def test_newest_reading_combines_before_the_shuffle(stored):
    assert "partial_max_by" in plan(latest_per_item(stored))


def test_intervals_read_their_source_once(stored):
    df = derive_intervals(stored)
    assert len(df.collect()) == 198
    final = plan(df).split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 1 and final.count("Scan parquet") == 1


def test_windows_split_every_capacity(stored, make):
    text = plan(score_history(stored, make.capacities()))
    keys = window_keys(text)
    assert len(keys) >= 3
    assert all("item_id" in k for k in keys), keys


def test_no_pairwise_joins(stored, make):
    scored = score_history(stored, make.capacities(guards={"min_capacity_utilization_percent": 5.0}))
    given = scored.withColumn("streak", F.lit(0)).withColumn("last_action_ts", F.lit(None).cast("timestamp_ntz"))
    text = plan(cycle_gates(assess(given)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not [k for k in window_keys(text) if "item_id" not in k]


def test_rank_selection_never_sorts_a_group(stored):
    """Windows run over bins and over the values of one bin, never over all values of a group."""
    df = percentile_nearest(stored, ["capacity_key"], "cu_seconds_today", {"p95": 0.95})
    assert df.first().p95 == 94.0
    text = plan(df)
    assert "partial_count" in text and "ReadSchema: struct<capacity_key:string,cu_seconds_today:double>" in text


def test_only_needed_columns_are_read(stored):
    text = plan(derive_intervals(stored).groupBy("capacity_key").agg(F.sum("cu_seconds")))
    assert "item_name" not in re.search(r"ReadSchema: struct<[^>]*>", text).group()


def test_one_item_may_hold_most_rows(make, spark):
    """A third of all readings in one item, over many days: the same as a plain difference."""
    hot = spark.range(20000).select(
        F.lit("north").alias("capacity_key"), F.lit("c").alias("capacity_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("i"), (F.col("id") % 500).cast("string"))).alias("item_id"),
        *[F.lit("x").alias(c) for c in ("item_name", "item_kind", "workspace_id", "workspace_name")],
        (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts"),
        F.col("id").cast("double").alias("cu_seconds_today"),
    )
    rows = derive_intervals(hot).toPandas()
    source = hot.toPandas().sort_values("ts")
    group = source.groupby("item_id")
    previous, before = group["ts"].shift(), group["cu_seconds_today"].shift()
    same = previous.dt.date == source["ts"].dt.date
    used = source["cu_seconds_today"].where(~same, source["cu_seconds_today"] - before)[previous.notna()]
    assert len(rows) == len(used)
    assert sorted(rows["cu_seconds"]) == sorted(used)


def test_readings_are_dealt_once_after_their_sums(spark, tmp_path):
    """The rows left of a log are dealt by item and day and sorted once, for sums and running sums."""
    path = str(tmp_path / "usage")
    rows = [(T0 + dt.timedelta(minutes=n), "north", "c17", i, "Old" if n < 90 else "New", "Model", "w", "W", 1.0) for n in range(180) for i in "ab"]
    spark.createDataFrame(rows, USAGE).write.parquet(path)
    readings = cumulative_snapshots(spark.read.parquet(path))
    text = plan(readings)
    assert text.count(" Exchange ") == 2 and text.count(" Sort ") == 1, text
    found = sorted((r.item_id, r.ts.hour, r.item_name, r.cu_seconds_today) for r in readings.collect())
    assert found == [(i, h, "Old" if h == 0 else "New", 60.0 * (h + 1)) for i in "ab" for h in range(3)]


def test_replayed_baselines_sort_intervals_once(stored, make):
    """Intervals are shuffled and sorted once for their baselines and never gathered as whole rows."""
    caps = make.capacities(interval_minutes=60)
    cadenced = with_cadence(policy_join(derive_intervals(stored), caps))
    own = plan(replay_baselines(cadenced, caps)).split("REPARTITION_BY_COL")[0]
    assert "collect_list" in own and own.count(" Sort ") == 1 and "ObjectHashAggregate" not in own, own


def test_calibration_moves_what_its_statistics_read(stored, make, tmp_path, spark):
    """Profiles never sort the intervals, and only columns that a statistic reads are written."""
    caps = make.capacities(interval_minutes=60)
    scored = score_history(stored, caps)
    text = plan(item_profile(policy_join(scored.select(*READ), caps).localCheckpoint()))
    below = [part for part in text.split("Exchange")[1:] if "partial_min(window_end" in part]
    assert below and "SortAggregate" not in below[0].split("partial_min(window_end")[0], text
    report = calibrate(derive_intervals(stored), caps).report
    assert report.first().total_intervals == scored.count()
