import datetime as dt

import pytest
from pyspark.sql import functions as F

from surgeline.functions.tiers import classify
from surgeline.operators.detect import advance_state, assess, capacity_guard, cycle_gates, run_budget, score, state_join
from surgeline.operators.intervals import with_cadence
from surgeline.policy import policy_join

T0 = dt.datetime(2029, 8, 15, 9, 0)
NOW = T0 + dt.timedelta(minutes=15)


def judged(make, rows, normal=(1000.0, 7), state=(), sku=None, **policy):
    caps = make.capacities(sku=sku, **policy)
    b = F.struct(
        F.lit(normal[0]).alias("value"), F.lit(normal[1]).alias("days"), F.lit(normal[1]).alias("samples"),
        F.lit("median").alias("method"),
    )
    cadenced = with_cadence(policy_join(make.intervals(*rows), caps)).withColumn("baseline", b)
    return assess(state_join(score(cadenced), make.state(*state)))


def verdict(df):
    r = df.first()
    return r.tier, r.effective_tier, r.suppressions


@pytest.mark.parametrize("ratio, tier", [(1.0, 0), (1.19, 0), (1.2, 1), (1.5, 2), (1.79, 2), (1.8, 3), (None, 0)])
def test_classify(spark, ratio, tier):
    steps = F.struct(F.lit(1.2).alias("alert"), F.lit(1.5).alias("throttle"), F.lit(1.8).alias("kill"))
    row = spark.range(1).select(classify(F.lit(ratio).cast("double"), steps).alias("tier")).first()
    assert row.tier == tier


def test_tiny_consumption(make):
    assert verdict(judged(make, [{"cu": 3}], (1.0, 7))) == (3, 0, ["below_min_cu"])


def test_few_days(make):
    assert verdict(judged(make, [{"cu": 7200}], (1000.0, 2), baseline={"min_days": 4})) == (3, 0, ["insufficient_baseline"])


def test_observe(make):
    assert verdict(judged(make, [{"cu": 7200}], mode="observe")) == (3, 1, ["observe_mode"])


@pytest.mark.parametrize(
    "protect, held",
    [
        ({"name_patterns": ["kosten"]}, True),
        ({"name_patterns": ["(?i)übersicht.*KOSTEN$"]}, True),
        ({"name_patterns": ["ÜBERSICHT"]}, True),
        ({"workspace_ids": ["w3"]}, True),
        ({"item_kinds": ["Model"]}, True),
        ({"item_ids": ["a1"]}, True),
        ({"item_ids": ["other"], "name_patterns": ["nothing"]}, False),
    ],
)
def test_protected(make, protect, held):
    rows = judged(make, [{"cu": 7200, "name": "Übersicht der Kosten"}], protect=protect)
    assert verdict(rows) == ((3, 1, ["protected"]) if held else (3, 3, []))


def test_streak_holds_the_first_breach(make):
    guards = {"consecutive_breaches": 2}
    first = judged(make, [{"cu": 7200}], guards=guards)
    assert verdict(first) == (3, 1, ["awaiting_consecutive_breaches"])
    state = advance_state(first).first()
    assert (state.streak, state.last_tier, state.last_action_ts) == (1, "kill", None)
    second = judged(make, [{"cu": 7200}], state=[("a1", 1, None)], guards=guards)
    assert verdict(second) == (3, 3, [])
    assert advance_state(second).first().last_action_ts == NOW


def test_normal_interval_resets_the_streak(make):
    rows = judged(make, [{"cu": 1100}], state=[("a1", 5, None)])
    assert verdict(rows) == (0, 0, [])
    assert advance_state(rows).first().streak == 0


@pytest.mark.parametrize("minutes, held", [(0, True), (59, True), (60, False), (200, False)])
def test_cooldown(make, minutes, held):
    state = [("a1", 0, NOW - dt.timedelta(minutes=minutes))]
    rows = judged(make, [{"cu": 7200}], state=state, guards={"cooldown_minutes": 60})
    assert verdict(rows) == ((3, 1, ["cooldown"]) if held else (3, 3, []))


@pytest.mark.parametrize(
    "window, held",
    [
        ({"days_of_month": [15]}, True),
        ({"start_hour": 1, "end_hour": 6}, False),
        ({"start_hour": 9, "end_hour": 10}, True),
        ({"days": [2]}, True),
        ({"days": [3]}, False),
        ({"days": []}, True),
    ],
)
def test_freeze(make, window, held):
    rows = judged(make, [{"cu": 7200}], freeze_windows=[{"name": "close"} | window])
    assert verdict(rows) == ((3, 1, ["freeze_window:close"]) if held else (3, 3, []))


def test_reasons_keep_their_order(make):
    rows = judged(
        make, [{"cu": 7200}], state=[("a1", 0, NOW - dt.timedelta(minutes=1))], mode="observe",
        protect={"item_ids": ["a1"]}, freeze_windows=[{"name": "x"}],
        guards={"cooldown_minutes": 60, "consecutive_breaches": 3},
    )
    expected = ["protected", "observe_mode", "freeze_window:x", "cooldown", "awaiting_consecutive_breaches"]
    assert verdict(rows) == (3, 1, expected)


@pytest.mark.parametrize("items, effective", [(20, 1), (6, 1), (5, 3), (3, 3)])
def test_budget(make, items, effective):
    rows = run_budget(judged(make, [{"cu": 7200, "item": f"i{i}"} for i in range(items)])).collect()
    assert len(rows) == items and {r.effective_tier for r in rows} == {effective}
    assert {tuple(r.suppressions) for r in rows} == {("max_actions_per_run",) if effective == 1 else ()}


@pytest.mark.parametrize("cu, effective", [(1440.0, 1), (6120.0, 3)])
def test_utilization_floor(make, cu, effective):
    """F8 offers 7200 in 15 minutes: 20 % and 85 % of it."""
    rows = judged(make, [{"cu": cu}], (100.0, 7), sku="f8", guards={"min_capacity_utilization_percent": 60.0})
    row = capacity_guard(rows).first()
    assert row.effective_tier == effective
    assert row.suppressions == (["capacity_utilization_below_60.0"] if effective == 1 else [])


def test_floor_without_sku_is_inactive(make):
    rows = judged(make, [{"cu": 7200}], guards={"min_capacity_utilization_percent": 60.0})
    assert cycle_gates(rows).first().effective_tier == 3
