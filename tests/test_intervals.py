import datetime as dt
from random import Random

import pytest
from surgeline.functions.calendar import naive

from surgeline.operators.intervals import derive_intervals, interval_pairing, intervals_from_pairs, with_cadence
from surgeline.operators.snapshots import latest_per_item, previous_snapshot, readings_as_of
from surgeline.policy import policy_join
from surgeline.schemas import USAGE
from surgeline.sources.usage import cumulative_snapshots, daily_cumulative

T0 = dt.datetime(2029, 8, 15, 9, 0)
QUARTER = dt.timedelta(minutes=15)
CADENCE, STRETCH = 15, 3  # minutes, and how far an interval may be from them


@pytest.mark.parametrize("chunk", ["day", "month", "year"])
@pytest.mark.parametrize(
    "first, second, used",
    [
        ((T0, 120), (T0 + QUARTER, 480.5), 360.5),
        ((T0, 77), (T0 + QUARTER, 77), 0.0),
        ((T0.replace(hour=23, minute=59), 640), (T0.replace(hour=0) + dt.timedelta(days=1), 650), 650.0),
        ((T0, 900), (T0 + QUARTER, 899), 899.0),
        ((dt.datetime(2029, 12, 31, 22, 0), 3), (dt.datetime(2030, 1, 1, 2, 0), 8), 8.0),
    ],
    ids=["difference", "nothing", "midnight", "reset", "new year"],
)
def test_consumption_between_two_readings(make, chunk, first, second, used):
    rows = derive_intervals(make.snapshots(("a", *first), ("a", *second)), chunk).collect()
    assert [(r.cu_seconds, r.window_start, r.window_end) for r in rows] == [(used, first[0], second[0])]


def test_first_reading_yields_nothing(make):
    assert derive_intervals(make.snapshots(("a", T0, 1000))).count() == 0


def test_chunks_do_not_change_the_result(make):
    """Long gaps, single readings per day and many per day, against a plain walk."""
    times = [T0 + dt.timedelta(hours=h) for h in (0, 1, 2, 30, 31, 100, 400, 401, 402, 5000)]
    readings = [(item, t, (i * 37) % 11 * 10) for item in "ab" for i, t in enumerate(times)]
    expected = set()
    for item in "ab":
        mine = [(t, cu) for i, t, cu in readings if i == item]
        for (t1, c1), (t2, c2) in zip(mine, mine[1:]):
            used = c2 - c1 if t1.date() == t2.date() and c2 >= c1 else c2
            expected.add((item, t1, t2, float(used)))
    for chunk in ("day", "month", "year"):
        rows = derive_intervals(make.snapshots(*readings), chunk).collect()
        assert {(r.item_id, r.window_start, r.window_end, r.cu_seconds) for r in rows} == expected
        assert len(rows) == len(expected)


def test_late_reading_is_rescaled(make):
    rows = with_cadence(policy_join(make.intervals({"cu": 3000, "minutes": 40}), make.capacities()))
    assert rows.first().normalized == pytest.approx(3000 * 15 / 40)


@pytest.mark.parametrize("minutes, comparable", [(CADENCE / STRETCH, True), (CADENCE / STRETCH - 1, False), (CADENCE, True), (CADENCE * STRETCH, True), (CADENCE * STRETCH + 1, False), (CADENCE * 100, False)])
def test_comparable_durations(make, minutes, comparable):
    rows = with_cadence(policy_join(make.intervals({"minutes": minutes}), make.capacities()))
    assert rows.first().comparable is comparable


def test_zero_minutes_is_never_comparable(make):
    row = with_cadence(policy_join(make.intervals({"minutes": 0, "cu": 7}), make.capacities())).first()
    assert row.comparable is False and row.normalized == 7.0


def test_bucket_by_hour_and_by_week(make):
    rows = make.intervals({"start": T0 - QUARTER})
    assert with_cadence(policy_join(rows, make.capacities())).first().bucket == "h9"
    weekly = make.capacities(baseline={"bucket": "hour_of_week"})
    assert with_cadence(policy_join(rows, weekly)).first().bucket == "d2h9"


def test_previous_snapshot_is_strictly_before(make):
    rows = make.snapshots(("a", T0, 31), ("a", T0 + QUARTER, 64))

    def at(minutes):
        before = naive(T0 + dt.timedelta(minutes=minutes))
        return [r.cu_seconds_today for r in previous_snapshot(rows, before).collect()]

    assert at(16) == [64.0] and at(15) == at(1) == [31.0] and at(0) == []


def test_pairing_one_cycle(make):
    current = make.snapshots(("a", T0 + QUARTER, 250), ("new", T0 + QUARTER, 5), ("stale", T0, 5))
    previous = latest_per_item(make.snapshots(("a", T0, 100), ("stale", T0, 4)))
    rows = intervals_from_pairs(interval_pairing(current, previous)).collect()
    assert [(r.item_id, r.cu_seconds) for r in rows] == [("a", 150.0)]


@pytest.mark.parametrize("chunk", ["day", "month"])
def test_readings_as_of_many_moments(spark, make, chunk):
    """Against a plain search; a third of all moments at one item, some at the very time of a reading,
    before the first one, days after the last, repeated, or null."""
    rng = Random(2)
    readings = [(i, T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 6)), n) for i in ("a", "b", "hot") for n in range(60)]
    readings = [(i, ts, n) for n, (i, ts) in enumerate({(i, ts) for i, ts, _ in readings})]
    asked = [(rng.choice(["a", "b", "hot", "hot", "none"]), T0 + dt.timedelta(minutes=rng.randrange(-60, 60 * 24 * 9))) for _ in range(400)]
    asked += [(i, ts) for i, ts, _ in readings[:40]] + asked[:30] + [("a", None), (None, T0)]
    schema = "capacity_key string, item_id string, moment timestamp_ntz, prev int, _chunk string"
    moments = spark.createDataFrame([("north", i, at, k, "x") for k, (i, at) in enumerate(asked)], schema)
    found = readings_as_of(moments, make.snapshots(*readings), chunk).collect()
    assert len(found) == len(asked)
    for r in found:
        i, at = asked[r.prev]
        past = [(ts, float(cu)) for j, ts, cu in readings if j == i and at is not None and ts < at]
        assert (r.prev_ts, r.prev_cu) == (max(past) if past else (None, None))


def test_the_raw_log_is_never_sorted(spark, tmp_path):
    """Sums combine in a hash aggregate below the first exchange; the renamed keep one row a key."""
    rows = [(T0 + dt.timedelta(minutes=n), "north", "c17", "a", "Old" if n < 50 else "New", "Model", "w", "W", 1.0) for n in range(100)]
    path = str(tmp_path / "usage")
    spark.createDataFrame(rows, USAGE).write.parquet(path)
    usage = spark.read.parquet(path)
    for df in (daily_cumulative(usage), cumulative_snapshots(usage)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        below = plan[max(k for k, line in enumerate(plan) if "Exchange" in line) :]
        assert any("HashAggregate" in line and "partial_sum" in line for line in below) and not any("Sort" in line for line in below)
    assert [(r.item_name, r.cu_seconds_today) for r in daily_cumulative(usage).collect()] == [("New", 100.0)]
    assert sorted((r.item_name, r.cu_seconds_today) for r in cumulative_snapshots(usage).collect()) == [("New", 60.0), ("New", 100.0)]
