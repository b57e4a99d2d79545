import datetime as dt

import pytest

from surgeline.operators.intervals import derive_intervals
from surgeline.operators.outbox import planned_actions
from surgeline.plans.replay import final_state, gate_history, score_fresh, score_history
from surgeline.schemas import SNAPSHOTS, USAGE
from surgeline.sources.tables import WatchTables
from surgeline.streaming.intervals import stream_intervals
from surgeline.streaming.usage import usage_stream_cumulative
from surgeline.streaming.watch import process_batch, refold

T0 = dt.datetime(2029, 8, 8, 9, 0)
QUARTER = dt.timedelta(minutes=15)


def catch_up(spark, folder, schema, write):
    query = write(spark.readStream.schema(schema).parquet(folder)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_intervals_carry_the_last_reading_and_skip_old_ones(spark, make, tmp_path):
    source, store = str(tmp_path / "in"), WatchTables(spark, str(tmp_path / "out"))
    portions = [
        [("a", T0 + QUARTER, 50), ("a", T0, 10), ("b", T0, 1), ("b", T0, 1)],
        [("a", T0 + 2 * QUARTER, 40), ("a", T0 + QUARTER / 3, 20), ("b", T0 + dt.timedelta(days=1), 7)],
    ]
    for portion in portions:
        make.snapshots(*portion).coalesce(1).write.mode("append").parquet(source)
        catch_up(spark, source, SNAPSHOTS, lambda stream: stream_intervals(stream, store, str(tmp_path / "cp")))
    rows = store.read_intervals(T0.date(), T0.date() + dt.timedelta(days=2)).collect()
    found = sorted((r.item_id, r.window_start, r.window_end, r.cu_seconds) for r in rows)
    assert found == [
        ("a", T0, T0 + QUARTER, 40.0),
        ("a", T0 + QUARTER, T0 + 2 * QUARTER, 40.0),
        ("b", T0, T0 + dt.timedelta(days=1), 7.0),
    ]


def test_backfill_of_one_hot_item(spark, make, tmp_path):
    """Thirty days of one item in one batch, out of order: no Python worker, one window a day."""
    source, store = str(tmp_path / "in"), WatchTables(spark, str(tmp_path / "out"))
    readings = [("hot", T0 + n * QUARTER, float(n % 50)) for n in range(96 * 30)]
    make.snapshots(*readings[::-1]).repartition(3).write.parquet(source)
    catch_up(spark, source, SNAPSHOTS, lambda stream: stream_intervals(stream, store, str(tmp_path / "cp")))
    rows = store.read_intervals(T0.date(), T0.date() + dt.timedelta(days=40))
    expected = derive_intervals(make.snapshots(*readings))
    shown = ["window_start", "window_end", "cu_seconds"]
    assert sorted(map(tuple, rows.select(*shown).collect())) == sorted(map(tuple, expected.select(*shown).collect()))


@pytest.mark.parametrize("lateness", [None, "1 hour"])
def test_cumulative_usage_restarts_at_midnight(spark, tmp_path, lateness):
    source, seen = str(tmp_path / "in"), {}

    def keep(batch, number):
        for r in batch.collect():
            seen[number, r.ts.date()] = r.cu_seconds_today

    def write(stream):
        sums = usage_stream_cumulative(stream, lateness)
        return sums.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp"))

    def used(ts, cu):
        return (ts, "north", "c17", "a", "A", "Dataset", "w", "W", cu)

    late = T0.replace(hour=23, minute=50)
    for portion in ([used(T0, 1.0), used(T0 + QUARTER, 2.5)], [used(late, 4.0), used(late + QUARTER, 3.0)]):
        spark.createDataFrame(portion, USAGE).coalesce(1).write.mode("append").parquet(source)
        catch_up(spark, source, USAGE, write)
    numbers = sorted({n for n, _ in seen})
    assert seen[numbers[0], T0.date()] == 3.5
    assert max(v for (n, day), v in seen.items() if day == T0.date()) == 7.5
    assert max(v for (n, day), v in seen.items() if day != T0.date()) == 3.0


def test_watch_equals_replay_and_survives_a_retry(spark, make, tmp_path):
    """Nine days in three batches, the second run twice, against one batch replay."""
    readings = []
    for day in range(9):
        for item, scale in (("a", 1), ("b", 3)):
            total = 0.0
            for n in range(4):
                total += 1000 * scale * (6 if (day in (7, 8) and n == 2) or (item, day, n) == ("a", 8, 1) else 1)
                readings.append((item, T0 + dt.timedelta(days=day) + n * QUARTER, total))
    caps = make.capacities(guards={"cooldown_minutes": 30, "max_actions_per_run": 1}, baseline={"min_days": 4})
    store = WatchTables(spark, str(tmp_path / "watch"))
    cuts = [T0 + dt.timedelta(days=d) for d in (5, 8, 99)]
    start = dt.datetime.min
    for number, cut in enumerate(cuts):
        batch = make.snapshots(*[r for r in readings if start <= r[1] < cut])
        for _ in range(2 if number == 1 else 1):
            process_batch(batch, number, store, caps)
        start = cut

    done = gate_history(score_history(make.snapshots(*readings), caps), caps)
    expected = sorted((r.item_id, r.window_end, r.tier, r.effective_tier, ",".join(r.suppressions)) for r in done.anomalies.collect())
    names = ["none", "alert", "throttle", "kill"]
    found = sorted(
        (r.item_id, r.ts, names.index(r.tier), names.index(r.effective_tier), r.suppressions) for r in store.read_events().collect()
    )
    assert found == expected and expected
    assert {r.item_id: r.streak for r in store.load_states().collect()} == {
        r.item_id: r.streak for r in final_state(done.verdicts).collect()
    }
    runs = store.read_runs().collect()
    assert sum(r.anomalies for r in runs) == len(expected) and sum(r.items_scanned for r in runs) == len(readings)
    assert {r.run_id for r in runs} == {"batch-0", "batch-1", "batch-2"} and not any(r.errors for r in runs)
    planned = planned_actions(done.anomalies)
    key = ["item_id", "window_end", "action"]
    ledger = sorted(map(tuple, store.read_actions().select(*key).collect()))
    assert ledger == sorted(map(tuple, planned.select(*key).collect())) and ledger
    store.rewind(2)
    process_batch(make.snapshots(*[r for r in readings if r[1] >= cuts[1]]), 9, store, caps)
    assert sorted(map(tuple, store.read_actions().select(*key).collect())) == ledger  # nothing is planned twice
    stored = store.read_intervals(T0.date(), T0.date() + dt.timedelta(days=30))
    assert stored.count() == derive_intervals(make.snapshots(*readings)).count()


def test_first_batch_only_bootstraps(spark, make, tmp_path):
    store = WatchTables(spark, str(tmp_path / "watch"))
    process_batch(make.snapshots(("a", T0, 5)), 0, store, make.capacities())
    assert store.read_snapshots().count() == 1
    assert store.read_events().count() == 0
    assert store.load_last_readings().count() == 1


def test_unreadable_rows_stop_nothing(spark, make, tmp_path):
    store = WatchTables(spark, str(tmp_path / "watch"))
    columns = "ts string, capacity_key string, capacity_id string, item_id string, item_name string, item_kind string, workspace_id string, workspace_name string, cu_seconds_today string, note int, _corrupt_record string"
    good = lambda cu, item="a", ts=T0, key="north": (str(ts), key, "c17", item, None, "", None, None, cu, 1, None)
    rows = [good("5"), good("7.5", ts=T0 + QUARTER), good("n/a", "b"), good("1", ""), good("1", None), good("1", key=None), good("2", "c", ts="yesterday"), good("", "d"), (None,) * 10 + ("{broken",), good("x", key="south"), good("y", "z", key="south")]
    process_batch(spark.createDataFrame(rows, columns), 0, store, make.capacities())
    found = sorted((r.capacity_key or "", r.reason) for r in store.read_quarantine().collect())
    assert found == sorted([("north", "unreadable_consumption"), ("north", "no_item"), ("north", "no_item"), ("", "no_capacity"), ("north", "no_time"), ("", "corrupt_record"), ("south", "unreadable_consumption"), ("south", "unreadable_consumption")])
    marks = {(r.capacity_key, r.reason): (r.rows, r.readable) for r in store.read_failures().collect()}
    assert marks["north", "no_item"] == (2, 3) and marks["south", "unreadable_consumption"] == (2, 0) and marks[None, "corrupt_record"] == (1, 0)
    kept = {(r.item_id, r.cu_seconds_today, r.item_name, r.item_kind) for r in store.read_snapshots().collect()}
    assert kept == {("a", 5.0, "a", "Unknown"), ("a", 7.5, "a", "Unknown"), ("d", 0.0, "d", "Unknown")}
    assert store.read_intervals(T0.date(), T0.date() + dt.timedelta(days=1)).count() == 1
    assert {r.errors for r in store.read_runs().collect()} == {4}
    assert all("broken" in r.row for r in store.read_quarantine().filter("reason = 'corrupt_record'").collect())


def test_only_fresh_days_are_judged(spark, make, tmp_path):
    """What is judged against stored days goes through no window, and no other days are listed."""
    store, caps = WatchTables(spark, str(tmp_path / "watch")), make.capacities(baseline={"lookback_days": 5})
    for n in range(4):
        day = T0 + dt.timedelta(days=n)
        process_batch(make.snapshots(*[(i, day + k * QUARTER, 10 * k) for i in "ab" for k in range(4)]), n, store, caps)
    since = T0.date() + dt.timedelta(days=1)
    samples = store.read_samples(since, T0.date() + dt.timedelta(days=3))
    assert sorted({r.day for r in samples.select("day").collect()}) == [since + dt.timedelta(days=k) for k in range(2)]
    assert all("day=2029-08-09" in f or "day=2029-08-10" in f for f in samples.inputFiles()) and samples.inputFiles()
    path = str(tmp_path / "fresh")
    derive_intervals(make.snapshots(*[(i, T0 + dt.timedelta(days=4) + k * QUARTER, 10 * k) for i in "ab" for k in range(4)])).write.parquet(path)
    text = score_fresh(spark.read.parquet(path), samples, caps)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in text and "Window [" not in text
    assert len(store._versions("item_state")) == 2


def test_samples_are_folded_anew_when_settings_change(spark, make, tmp_path):
    store = WatchTables(spark, str(tmp_path / "watch"))
    days = lambda a, b: make.snapshots(*[("a", T0 + dt.timedelta(days=n) + k * QUARTER, 100 * k) for n in range(a, b) for k in range(3)])
    process_batch(days(0, 7), 0, store, make.capacities(baseline={"bucket": "hour_of_week"}))
    caps = make.capacities(guards={"max_interval_stretch": 2.0})
    period = T0.date(), T0.date() + dt.timedelta(days=30)
    refold(store, caps, *period, batch=-1)
    refold(store, caps, *period, batch=-2)
    fresh = derive_intervals(days(7, 8))
    found = {r.window_end: r.baseline for r in score_fresh(fresh, store.read_samples(*period), caps).collect()}
    expected = {r.window_end: r.baseline for r in score_history(days(0, 8), caps).collect() if r.window_end >= T0 + dt.timedelta(days=7)}
    assert found == expected and all(b.days == 7 for b in found.values())
