"""The whole history at once against a plain walk through the cycles."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from surgeline.operators.cooldown import replay_cooldowns
from surgeline.operators.detect import with_streak
from surgeline.plans.replay import final_state, gate_history, score_history
from surgeline.schemas import ITEM_STATE, record, TEXT, TIME, NUMBER, WHOLE
from surgeline.policy import PolicySet
from pyspark.sql import types as T

START = dt.datetime(2029, 8, 1)


def walk(rows, cooldown, breaches, most, state):
    """rows: (capacity, item, ts, tier). Returns verdicts and the final state."""
    streak = {k: v[0] for k, v in state.items()}
    last = {k: v[1] for k, v in state.items()}
    out = {}
    cycles = {}
    for capacity, item, ts, tier in rows:
        cycles.setdefault((ts, capacity), []).append((item, tier))
    for (ts, capacity), items in sorted(cycles.items()):
        verdicts = {}
        for item, tier in items:
            key = capacity, item
            why = []
            if tier:
                before = last.get(key)
                if before and cooldown and (ts - before).total_seconds() / 60 < cooldown:
                    why.append("cooldown")
                if streak.get(key, 0) + 1 < breaches:
                    why.append("awaiting_consecutive_breaches")
            verdicts[item] = [tier, min(tier, 1) if why else tier, why]
        acting = [i for i, v in verdicts.items() if v[1] >= 2]
        if len(acting) > most:
            for item in acting:
                verdicts[item][1] = 1
                verdicts[item][2].append("max_actions_per_run")
        for item, (tier, effective, why) in verdicts.items():
            key = capacity, item
            out[capacity, item, ts] = (tier, effective, streak.get(key, 0), tuple(why))
            streak[key] = streak.get(key, 0) + 1 if tier else 0
            if effective >= 2:
                last[key] = ts
    return out, {k: (streak[k], last.get(k)) for k in streak}


SCORED = record(
    capacity_key=TEXT, item_id=TEXT, item_name=TEXT, item_kind=TEXT, workspace_id=TEXT, workspace_name=TEXT,
    window_end=TIME, cu_seconds=NUMBER, minutes=NUMBER, normalized=NUMBER, ratio=NUMBER, tier=WHOLE,
    baseline=record(value=NUMBER, days=WHOLE, samples=WHOLE, method=TEXT),
)


@pytest.mark.parametrize("seed", range(4))
def test_streak_cooldown_and_budget(spark, seed):
    rng = random.Random(seed)
    cooldown, breaches, most = rng.choice([(0, 1, 2), (60, 1, 1), (90, 2, 2), (45, 1, 3)])
    rows, state = [], {}
    for capacity in ("X", "Y"):
        for item in "abcde":
            if rng.random() < 0.5:
                state[capacity, item] = (rng.randint(0, 3), START - dt.timedelta(minutes=rng.choice([10, 50, 200])))
            for n in range(400):
                if rng.random() < 0.8:
                    ts = START + dt.timedelta(minutes=15 * n)
                    rows.append((capacity, item, ts, rng.choice([0, 1, 2, 3, 3])))
    expected, expected_state = walk(rows, cooldown, breaches, most, state)

    guards = {"cooldown_minutes": cooldown, "consecutive_breaches": breaches, "max_actions_per_run": most, "min_cu_seconds": 0.0}
    policies = PolicySet([{"key": k, "id": k} for k in "XY"], {"mode": "enforce", "guards": guards})
    caps = policies.frame(spark)
    data = [
        (c, i, i, "Dataset", "w", "W", ts, 10.0, 15.0, 10.0, float(tier), tier, (1.0, 9, 9, "median")) for c, i, ts, tier in rows
    ]
    scored = spark.createDataFrame(data, SCORED)
    prior = spark.createDataFrame([(c, i, s, "alert", a, None) for (c, i), (s, a) in state.items()], ITEM_STATE)
    done = gate_history(scored, caps, prior)
    found = {
        (r.capacity_key, r.item_id, r.window_end): (r.tier, r.effective_tier, r.streak, tuple(r.suppressions))
        for r in done.anomalies.collect()
    }
    assert found == {k: v for k, v in expected.items() if v[0]}
    ended = {(r.capacity_key, r.item_id): (r.streak, r.last_action_ts) for r in final_state(done.verdicts, prior).collect()}
    assert ended == expected_state


def test_streak_without_state_over_midnights(spark):
    rng = random.Random(3)
    rows = [("X", "a", START + dt.timedelta(hours=5 * n), int(rng.random() < 0.85)) for n in range(300)]
    expected, run = {}, 0
    for _, _, ts, tier in rows:
        expected[ts] = run
        run = run + 1 if tier else 0
    df = spark.createDataFrame(rows, record(capacity_key=TEXT, item_id=TEXT, window_end=TIME, tier=WHOLE))
    assert {r.window_end: r.streak for r in with_streak(df).collect()} == expected


def test_one_jump_among_even_days(make):
    """Ten days with the same use in one hour, then four times as much."""
    readings = []
    for day in range(11):
        at = START + dt.timedelta(days=day, hours=6)
        readings += [("a", at, 40), ("a", at + dt.timedelta(minutes=15), 40 + (250 if day < 10 else 1000))]
    caps = make.capacities(baseline={"lookback_days": 10})
    done = gate_history(score_history(make.snapshots(*readings), caps), caps)
    (row,) = done.anomalies.collect()
    assert (row.tier, row.effective_tier, row.ratio, row.baseline.days) == (3, 3, 4.0, 10)


def jobs_of(spark, run):
    """Spark jobs that a call starts."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def gating(spark, cycles, items, limit, cooldown, skip=lambda c, i: False, prior=None):
    rows = [("X", f"i{i}", START + dt.timedelta(minutes=15 * c), not skip(c, i), cooldown, limit) for c in range(cycles) for i in range(items)]
    schema = record(capacity_key=TEXT, item_id=TEXT, window_end=TIME, eligible=T.BooleanType(), cooldown_minutes=WHOLE, max_actions=WHOLE)
    return rows, spark.createDataFrame(rows, schema)


def test_as_many_jobs_for_many_crowded_cycles_as_for_few(spark):
    counts = []
    for cycles in (24, 672):
        _, df = gating(spark, cycles, 5, 2, 30, lambda c, i: (c * 7 + i * 3) % 4 == 0)
        df = df.repartition(4).cache()
        df.count()
        counts.append(jobs_of(spark, lambda: replay_cooldowns(df).write.format("noop").mode("overwrite").save()))
    assert counts[0] == counts[1], counts


@pytest.mark.parametrize("seed", range(3))
def test_cooldown_in_segments(spark, seed):
    """Bursts with pauses of any length between them, limits from 0, items that come and go."""
    rng = random.Random(seed)
    cooldown, limit = rng.choice([15, 40, 120]), rng.choice([0, 1, 3])
    rows, cycle = [], 0
    for _ in range(40):
        cycle += rng.choice([1, 1, 1, 2, 5, 20])
        for i in range(8):
            if rng.random() < 0.6:
                rows.append(("X", f"i{i}", START + dt.timedelta(minutes=15 * cycle), rng.random() < 0.8, cooldown, limit))
    schema = record(capacity_key=TEXT, item_id=TEXT, window_end=TIME, eligible=T.BooleanType(), cooldown_minutes=WHOLE, max_actions=WHOLE)
    prior = {f"i{i}": START + dt.timedelta(minutes=rng.choice([-30, 5])) for i in range(0, 8, 3)}
    state = spark.createDataFrame([("X", i, 0, "alert", at, None) for i, at in prior.items()], ITEM_STATE)
    last, expected = dict(prior), {}
    for ts in sorted({r[2] for r in rows}):
        here = [r for r in rows if r[2] == ts]
        acting = [r[1] for r in here if r[3] and not (r[1] in last and (ts - last[r[1]]).total_seconds() < 60 * cooldown)]
        over = len(acting) > limit
        for r in here:
            expected[r[1], ts] = (last.get(r[1]), r[1] in acting, over)
        if not over:
            last |= dict.fromkeys(acting, ts)
    found = replay_cooldowns(spark.createDataFrame(rows, schema).repartition(3), state).collect()
    assert {(r.item_id, r.window_end): (r.last_action_ts, r.actionable, r.over_budget) for r in found} == expected


def test_fold_holds_few_actions():
    """Ten thousand items in a crowded cycle: what is kept is bounded by the limit."""
    import pandas as pd

    from surgeline.operators import cooldown as cd

    n = 10_000
    rows = pd.DataFrame({"capacity_key": "X", "_segment": 0, "_second": 900, "window_end": pd.Timestamp("2029-01-01"), "item_id": [f"i{i}" for i in range(n)], "_initial_second": float("nan"), "_cooldown_seconds": 60.0, "_crowded": True, "_limit": 3})
    later = rows.assign(_second=960, window_end=pd.Timestamp("2029-01-01 00:01"))[:3]
    fold = cd._fold_partition(iter([rows[:5000], rows[5000:], later]))
    assert pd.concat(list(fold))["window_end"].tolist() == [pd.Timestamp("2029-01-01")]
