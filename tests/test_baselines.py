import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from surgeline.operators.baselines import baseline_history, compute_baselines, day_samples, extend_baselines, lookback_classes, replay_baselines
from surgeline.operators.intervals import with_cadence
from surgeline.policy import PolicySet, policy_join
from surgeline.schemas import INTERVALS

DAY = dt.date(2029, 8, 15)


def at(day, hour=9, minute=0):
    return dt.datetime(2029, 8, day, hour, minute)


def baselines(make, rows, **policy):
    caps = make.capacities(**policy)
    cadenced = with_cadence(policy_join(make.intervals(*rows), caps))
    found = compute_baselines(baseline_history(cadenced, F.lit(DAY)), caps).collect()
    return {(r.item_id, r.bucket): r.baseline for r in found}


def test_gap_is_left_out(make):
    rows = [{"start": at(13)}, {"start": at(13, 9, 15), "minutes": 700}]
    b = baselines(make, rows, baseline={"method": "mean", "trim_top_percent": 0.0})["a1", "h9"]
    assert (b.value, b.samples, b.days) == (1000.0, 1, 1)


def test_irregular_cadence(make):
    rows = [{"start": at(13), "cu": 1800, "minutes": 20}, {"start": at(14), "cu": 650}]
    b = baselines(make, rows, baseline={"method": "mean", "trim_top_percent": 0.0})["a1", "h9"]
    assert (b.value, b.days) == (1000.0, 2)  # 1800 in 20 minutes are 1350 in 15


def test_buckets_do_not_mix(make):
    found = baselines(make, [{"start": at(13)}, {"start": at(12, 3), "cu": 9}])
    assert found["a1", "h9"].samples == 1 and found["a1", "h3"].value == 9.0


def test_current_day_and_old_days_are_no_history(make):
    assert baselines(make, [{"start": at(15)}, {"start": at(7)}]) == {}
    assert baselines(make, [{"start": at(8)}])["a1", "h9"].days == 1


def test_trimming_removes_the_spike(make):
    rows = [{"start": at(9 + i), "cu": cu} for i, cu in enumerate([60, 8800, 50, 70])]
    b = baselines(make, rows, baseline={"method": "mean", "trim_top_percent": 25.0})["a1", "h9"]
    assert (b.value, b.samples) == (60.0, 4)


def summary(values, method, trim):
    values = sorted(values)
    if trim > 0 and len(values) >= 4:
        values = values[: max(1, int(len(values) * (1 - trim / 100.0)))]
    if method == "mean":
        return statistics.fmean(values)
    if method == "median":
        return statistics.median(values)
    return values[round({"p75": 0.75, "p90": 0.9}[method] * (len(values) - 1))]


@pytest.mark.parametrize("method", ["mean", "median", "p75", "p90"])
@pytest.mark.parametrize("bucket", ["hour_of_day", "hour_of_week"])
def test_replay_equals_a_plain_walk(make, method, bucket):
    """Two items, up to four readings an hour, over 20 days, lookback 9 inside a frame of 12."""
    rng = random.Random(7)
    rows = []
    for item in "ab":
        for day in range(1, 21):
            for hour in (3, 9):
                for quarter in range(rng.randint(0, 4)):
                    rows.append({"item": item, "start": at(day, hour, quarter * 10), "minutes": 10, "cu": rng.randint(1, 5000) / 4})
    caps = make.capacities(baseline={"method": method, "bucket": bucket, "lookback_days": 9, "trim_top_percent": 20.0})
    cadenced = with_cadence(policy_join(make.intervals(*rows), caps))
    found = {
        (r.item_id, r.window_end): r.baseline for r in replay_baselines(cadenced, caps).collect()
    }
    assert len(found) == len(rows)
    for r in rows:
        end = r["start"] + dt.timedelta(minutes=10)
        same = [
            h for h in rows
            if h["item"] == r["item"] and h["start"].hour == r["start"].hour
            and 1 <= (r["start"].date() - h["start"].date()).days <= 9
            and (bucket == "hour_of_day" or h["start"].weekday() == r["start"].weekday())
        ]
        b = found[r["item"], end]
        if not same:
            assert b is None
            continue
        assert b.samples == len(same)
        assert b.days == len({h["start"].date() for h in same})
        assert b.value == pytest.approx(summary([h["cu"] * 1.5 for h in same], method, 20.0), rel=1e-12)


def test_each_capacity_looks_back_as_far_as_it_asks(spark):
    """Two lookbacks at once, the longer one ninety days; neither is cut, whoever stands beside it."""
    settings = {"interval_minutes": 15, "guards": {"min_cu_seconds": 0.0}}
    listed = [{"key": k, "id": k, "overrides": {"baseline": {"lookback_days": n, "method": "mean", "trim_top_percent": 0.0}}} for k, n in (("near", 3), ("far", 90))]
    caps = PolicySet(listed, settings).frame(spark)
    assert lookback_classes(caps) == [3, 90]
    start = dt.datetime(2029, 1, 1, 9)
    days = [n for n in range(100) if n % 7 != 5]
    rows = [(k, "a", "A", "Model", "w", "W", start + dt.timedelta(days=n), start + dt.timedelta(days=n, minutes=15), float(n * n % 101)) for k in ("near", "far") for n in days]
    cadenced = with_cadence(policy_join(spark.createDataFrame(rows, INTERVALS), caps))
    found = {(r.capacity_key, (r.window_end.date() - start.date()).days): r.baseline for r in replay_baselines(cadenced, caps).collect()}
    for key, lookback in (("near", 3), ("far", 90)):
        for n in days:
            past = [m * m % 101 for m in days if 1 <= n - m <= lookback]
            b = found[key, n]
            assert (b is None) == (not past) and (not past or (b.samples, b.days) == (len(past), len(past)) and b.value == pytest.approx(statistics.fmean(past)))


def test_extended_baselines_equal_replayed_ones(make):
    """Stored day by day, some days in two parts, one part twice, and samples under other settings."""
    rng = random.Random(4)
    rows = [{"item": i, "start": at(d, 9, 10 * q), "minutes": 10, "cu": rng.randint(1, 900)} for i in "ab" for d in range(1, 21) for q in range(rng.randint(0, 4))]
    caps = make.capacities(baseline={"lookback_days": 6})
    cadenced = with_cadence(policy_join(make.intervals(*rows), caps))
    expected = {(r.item_id, r.window_end): r.baseline for r in replay_baselines(cadenced, caps).collect()}
    early, late = (cadenced.filter(c) for c in ("day(window_end) <= 15", "day(window_end) > 15"))
    half = day_samples(early.filter("minute(window_end) < 25"))
    other = day_samples(early).withColumn("basis", F.lit("60|hour_of_day|2.0"))
    stored = half.unionByName(day_samples(early.filter("minute(window_end) >= 25"))).unionByName(half).unionByName(other)
    found = {(r.item_id, r.window_end): r.baseline for r in extend_baselines(late, stored, caps).collect()}
    assert found == {k: v for k, v in expected.items() if k[1].day > 15} and found


def test_unknown_consumption_counts_as_a_sample(make):
    """A null among the samples of a day is counted, sorts first and makes a mean unknown."""
    rows = [{"start": at(13)}, {"start": at(14)}, {"start": at(14, 9, 20)}, {"start": at(15)}]
    caps = make.capacities(baseline={"method": "p90", "trim_top_percent": 0.0})
    known = make.intervals(*rows).withColumn("cu_seconds", F.when(F.col("window_start") != F.lit(at(14)).cast("timestamp_ntz"), F.col("cu_seconds")))
    found = {(r.window_end.day, r.window_end.minute): r.baseline for r in replay_baselines(with_cadence(policy_join(known, caps)), caps).collect()}
    assert found[13, 15] is None and found[14, 15] == found[14, 35] and (found[14, 15].samples, found[14, 15].days) == (1, 1)
    assert (found[15, 15].samples, found[15, 15].days, found[15, 15].value) == (3, 2, 1000.0)
