import datetime as dt

import pytest

from surgeline.operators.baselines import baseline_history  # noqa: F401
from surgeline.schemas import EVENTS
from surgeline.sources.tables import WatchTables, merge_states

T0 = dt.datetime(2029, 8, 15, 9, 0)
DAY = dt.timedelta(days=1)


@pytest.fixture
def store(spark, tmp_path):
    return WatchTables(spark, str(tmp_path / "watch"))


def values(df):
    return sorted((r.item_id, r.ts, r.cu_seconds_today) for r in df.collect())


def test_last_write_wins(store, make):
    store.write_snapshots(make.snapshots(("a", T0, 1), ("b", T0, 2)), 0)
    store.write_snapshots(make.snapshots(("a", T0, 9), ("a", T0 + DAY, 3)), 1)
    expected = [("a", T0, 9.0), ("a", T0 + DAY, 3.0), ("b", T0, 2.0)]
    assert values(store.read_snapshots()) == expected
    store.write_snapshots(make.snapshots(("a", T0, 9), ("a", T0 + DAY, 3)), 1)
    assert values(store.read_snapshots()) == expected


def test_intervals_by_day_and_hour(store, make):
    store.write_intervals(make.intervals({"start": T0}, {"start": T0.replace(hour=3)}, {"start": T0 - DAY}))
    day = T0.date()

    def count(**kw):
        return store.read_intervals(day, day + DAY, **kw).count()

    assert (count(hours=[9]), count(), count(capacity_key="other")) == (1, 2, 0)
    row = store.read_intervals(day, day + DAY, hours=[3]).first()
    assert (row.day, row.hour, row.dow) == (day, 3, 2)


def test_interval_reads_prune_partitions(store, make):
    store.write_intervals(make.intervals({"start": T0}))
    plan = store.read_intervals(T0.date(), T0.date() + DAY, "north", [9])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [" in plan and "EqualTo(capacity_key,north)" in plan


def test_rewritten_batch_leaves_no_duplicate_events(store, spark):
    row = (T0, "r", "north", "observe", "a", "A", "Dataset", "w", "kill", "alert", 2.0, 1.0, 0.5, 7, 0, "", "", "")
    for _ in range(2):
        store.write_events(spark.createDataFrame([row], EVENTS), 3)
    assert store.read_events().count() == 1


def test_states_merge_into_versions(store, make):
    assert store.load_states().count() == 0
    store.save_states(make.state(("a", 1, T0), ("b", 2, None)), 0)
    store.save_states(make.state(("b", 3, T0), ("c", 0, None)), 1)
    kept = {r.item_id: (r.streak, r.last_action_ts) for r in store.load_states().collect()}
    assert kept == {"a": (1, T0), "b": (3, T0), "c": (0, None)}
    store.save_states(make.state(("b", 3, T0), ("c", 0, None)), 1)
    assert store.load_states().count() == 3
    assert store.load_states(before=1).count() == 2


def test_merge_replaces_with_nulls(make):
    merged = merge_states(make.state(("a", 1, T0)), make.state(("a", 0, None))).first()
    assert (merged.streak, merged.last_action_ts) == (0, None)


def test_prune_keeps_the_rest_of_the_cutoff_day(store, make):
    times = [T0 - DAY, T0 - dt.timedelta(hours=1), T0, T0 + DAY]
    store.write_snapshots(make.snapshots(*[("a", t, 1) for t in times]))
    assert store.prune_snapshots(T0) == 2
    assert [v[1] for v in values(store.read_snapshots())] == [T0, T0 + DAY]
    assert store._children("snapshots").count("day=2029-08-14") == 0
    assert store.prune_snapshots(T0) == 0


def test_prunes_stay_in_force_and_spare_later_rows(store, make):
    times = [T0 - dt.timedelta(hours=h) for h in (1, 2, 3)]
    store.write_snapshots(make.snapshots(*[("a", t, 1) for t in times]), 0)
    assert store.prune_snapshots(T0 - dt.timedelta(minutes=90)) == 2
    assert store.prune_snapshots(T0 - dt.timedelta(hours=5)) == 0
    assert [v[1] for v in values(store.read_snapshots())] == times[:1]
    store.write_snapshots(make.snapshots(("a", times[2], 7)), 1)
    assert sorted(v[1] for v in values(store.read_snapshots())) == [times[2], times[0]]
