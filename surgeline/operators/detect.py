"""The verdict on each interval: tier, safety gates, and what remains of the tier after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import minutes_between, weekday
from ..functions.tiers import ALERT, NONE, THROTTLE, classify, ratio_to_baseline, tier_label
from ..schemas import CYCLE, ITEM

# Reasons recorded when a gate holds an action back.
INSUFFICIENT_BASELINE = "insufficient_baseline"
BELOW_MIN_CU = "below_min_cu"
PROTECTED = "protected"
OBSERVE_MODE = "observe_mode"
FREEZE_WINDOW = "freeze_window"
COOLDOWN = "cooldown"
AWAITING_BREACHES = "awaiting_consecutive_breaches"
RUN_BUDGET = "max_actions_per_run"
UTILIZATION_BELOW = "capacity_utilization_below_"


def score(intervals: DataFrame) -> DataFrame:
    """Add `ratio` and `tier` to rows with `normalized`, `baseline` and `policy`."""
    scored = intervals.withColumn("ratio", ratio_to_baseline(F.col("normalized"), F.col("baseline")))
    return scored.withColumn("tier", classify(F.col("ratio"), F.col("policy")["thresholds"]))


def is_protected(protect: Column) -> Column:
    """By item, workspace or kind, or by a pattern found in the name (Unicode, any case)."""
    name = F.coalesce(F.col("item_name"), F.lit(""))
    by_name = F.exists(
        protect["name_patterns"], lambda p: F.rlike(name, F.concat(F.lit("(?iu)"), p))
    )
    listed = (
        F.array_contains(protect["item_ids"], F.col("item_id"))
        | F.array_contains(protect["workspace_ids"], F.col("workspace_id"))
        | F.array_contains(protect["item_kinds"], F.col("item_kind"))
    )
    return F.coalesce(listed, F.lit(False)) | by_name


def freeze_window(when: Column, windows: Column) -> Column:
    """Name of the first freeze window holding the moment, or NULL. Empty day lists match all."""

    def holds(w: Column) -> Column:
        return (
            ((F.size(w["days"]) == 0) | F.array_contains(w["days"], weekday(when)))
            & ((F.size(w["days_of_month"]) == 0) | F.array_contains(w["days_of_month"], F.dayofmonth(when)))
            & (w["start_hour"] <= F.hour(when))
            & (F.hour(when) < w["end_hour"])
        )

    return F.get(F.filter(windows, holds), F.lit(0))["name"]


def in_cooldown(now: Column, last_action: Column, cooldown_minutes: Column) -> Column:
    elapsed = minutes_between(last_action, now)
    return F.coalesce((cooldown_minutes > 0) & (elapsed < cooldown_minutes), F.lit(False))


def assess(scored: DataFrame, now: str = "window_end") -> DataFrame:
    """Run the per-item gates. Needs `streak` (before this interval) and `last_action_ts`.

    Too little history or consumption drops the effective tier to none and ends the matter; the
    other gates cap it at alert, and each one that holds leaves its reason.
    """
    p, when = F.col("policy"), F.col(now)
    few = F.col("baseline")["days"] < p["baseline"]["min_days"]
    low = F.col("normalized") < p["guards"]["min_cu_seconds"]
    frozen = freeze_window(when, p["freeze_windows"])
    gates = [
        F.when(is_protected(p["protect"]), F.lit(PROTECTED)),
        F.when(p["mode"] != "enforce", F.lit(OBSERVE_MODE)),
        F.when(frozen.isNotNull(), F.concat(F.lit(FREEZE_WINDOW + ":"), frozen)),
        F.when(
            in_cooldown(when, F.col("last_action_ts"), p["guards"]["cooldown_minutes"]), F.lit(COOLDOWN)
        ),
        F.when(F.col("streak") + 1 < p["guards"]["consecutive_breaches"], F.lit(AWAITING_BREACHES)),
    ]
    none = F.array().cast("array<string>")
    reasons = (
        F.when(F.col("tier") == NONE, none)
        .when(few, F.array(F.lit(INSUFFICIENT_BASELINE)))
        .when(low, F.array(F.lit(BELOW_MIN_CU)))
        .otherwise(F.array_compact(F.array(*gates)))
    )
    effective = (
        F.when((F.col("tier") == NONE) | few | low, NONE)
        .when(F.size("suppressions") > 0, F.least(F.col("tier"), F.lit(ALERT)))
        .otherwise(F.col("tier"))
    )
    return scored.withColumn("suppressions", reasons).withColumn("effective_tier", effective)


def utilization_pct(assessed: DataFrame) -> DataFrame:
    """Consumption of each cycle in percent of what the SKU offers; NULL if unknown."""
    per_cycle = assessed.groupBy(*CYCLE).agg(
        F.sum("cu_seconds").alias("_used"),
        F.max("minutes").alias("_minutes"),
        F.max("cu_per_second").alias("_rate"),
    )
    budget = F.col("_rate") * F.col("_minutes") * 60.0
    return per_cycle.select(*CYCLE, F.when(budget > 0, F.col("_used") * 100.0 / budget).alias("utilization"))


def _hold_back(df: DataFrame, hit: Column, reason: Column) -> DataFrame:
    """Cap rows at alert and append the reason."""
    marked = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return (
        marked.withColumn(
            "suppressions",
            F.when(F.col("_hit"), F.array_append("suppressions", reason)).otherwise(F.col("suppressions")),
        )
        .withColumn(
            "effective_tier",
            F.when(F.col("_hit"), F.least(F.col("effective_tier"), F.lit(ALERT))).otherwise(
                F.col("effective_tier")
            ),
        )
        .drop("_hit")
    )


def idle_cycles(rows: DataFrame) -> DataFrame:
    """Cycles whose utilization lies below the floor of their capacity. Capacities without a floor
    are left out before anything is summed."""
    floor = F.col("policy")["guards"]["min_capacity_utilization_percent"]
    floored = rows.filter(floor.isNotNull())
    floors = floored.groupBy("capacity_key").agg(F.max(floor).alias("_floor"))
    return (
        utilization_pct(floored)
        .join(floors, "capacity_key")
        .filter(F.col("utilization") < F.col("_floor"))
        .select(*CYCLE, F.lit(True).alias("idle"))
    )


def capacity_guard(assessed: DataFrame) -> DataFrame:
    """Below the utilization floor nobody is hurt, so nobody is acted on.

    The cycle's total is an aggregate joined back, not a window: a capacity with very many items
    is combined map-side and never gathered in one task.
    """
    with_use = assessed.join(idle_cycles(assessed), CYCLE, "left")
    floor = F.col("policy")["guards"]["min_capacity_utilization_percent"]
    hit = F.col("idle") & (F.col("effective_tier") >= THROTTLE)
    return _hold_back(with_use, hit, F.concat(F.lit(UTILIZATION_BELOW), floor.cast("string"))).drop("idle")


def dropped(suppressions: Column) -> Column:
    """Anomalies that a lack of history or of consumption took out before the other gates."""
    return F.array_contains(suppressions, INSUFFICIENT_BASELINE) | F.array_contains(suppressions, BELOW_MIN_CU)


def cycle_holds(assessed: DataFrame, idle: Column, over_budget: Column) -> DataFrame:
    """Apply both cycle gates where it is already known which rows they hit."""
    floor = F.col("policy")["guards"]["min_capacity_utilization_percent"]
    acting = F.col("effective_tier") >= THROTTLE
    held = _hold_back(assessed, idle & acting, F.concat(F.lit(UTILIZATION_BELOW), floor.cast("string")))
    return _hold_back(held, over_budget & acting, F.lit(RUN_BUDGET))


def over_budget_cycles(actionable: DataFrame) -> DataFrame:
    """Cycles in which more items would be acted on than the policy allows."""
    counts = actionable.groupBy(*CYCLE).agg(
        F.count("*").alias("_n"), F.max("_limit").alias("_limit")
    )
    return counts.filter(F.col("_n") > F.col("_limit")).select(*CYCLE)


def run_budget(assessed: DataFrame) -> DataFrame:
    """Too many actions in one cycle point to the system, not the items: act on none of them."""
    limit = F.col("policy")["guards"]["max_actions_per_run"].alias("_limit")
    actionable = assessed.filter(F.col("effective_tier") >= THROTTLE).select(*CYCLE, limit)
    exceeded = over_budget_cycles(actionable).withColumn("_over", F.lit(True))
    hit = F.col("_over") & (F.col("effective_tier") >= THROTTLE)
    return _hold_back(assessed.join(exceeded, CYCLE, "left"), hit, F.lit(RUN_BUDGET)).drop("_over")


def cycle_gates(assessed: DataFrame) -> DataFrame:
    """Gates that look at a whole cycle: utilization first, then the budget."""
    return run_budget(capacity_guard(assessed))


def state_join(scored: DataFrame, state: DataFrame) -> DataFrame:
    """Streak and last action carried from earlier cycles, 0 and NULL for unseen items."""
    carried = state.select(*ITEM, F.col("streak").alias("_streak"), "last_action_ts")
    return (
        scored.join(carried, ITEM, "left")
        .withColumn("streak", F.coalesce("_streak", F.lit(0)))
        .drop("_streak")
    )


def advance_state(gated: DataFrame, now: str = "window_end") -> DataFrame:
    """State after one cycle, a row per judged item."""
    breach = F.col("tier") >= ALERT
    acted = F.col("effective_tier") >= THROTTLE
    return gated.select(
        *ITEM,
        F.when(breach, F.col("streak") + 1).otherwise(0).alias("streak"),
        tier_label(F.col("tier")).alias("last_tier"),
        F.when(acted, F.col(now)).otherwise(F.col("last_action_ts")).alias("last_action_ts"),
        F.col(now).alias("last_seen_ts"),
    )


def with_streak(scored: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Consecutive breaches before each interval, for a whole history.

    Runs are counted inside each day, and a summary of one row per item and day carries a run
    over midnight; no window spans more than a day of rows or a calendar of summaries.
    """
    breach = (F.col("tier") > NONE).cast("int")
    by_day = Window.partitionBy(*ITEM, "_day").orderBy("window_end")
    sofar = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        scored.withColumn("_day", F.to_date("window_end"))
        .withColumn("_island", F.sum(1 - breach).over(sofar))
        .withColumn(
            "_run",
            F.sum(breach).over(
                Window.partitionBy(*ITEM, "_day", "_island")
                .orderBy("window_end")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("_before", F.lag("_run", 1, 0).over(by_day))
        .withColumn("_resets", F.coalesce(F.lag("_island").over(by_day), F.lit(0)))
    )
    days = marked.groupBy(*ITEM, "_day").agg(
        F.max("_island").alias("_breaks"), F.max_by("_run", "window_end").alias("_tail")
    )
    calendar = Window.partitionBy(*ITEM).orderBy("_day")
    carried = (
        days.withColumn("_era", F.sum((F.col("_breaks") > 0).cast("int")).over(calendar))
        .withColumn("_open", F.sum("_tail").over(Window.partitionBy(*ITEM, "_era").orderBy("_day")))
        .select(
            *ITEM,
            "_day",
            F.lag("_open", 1, 0).over(calendar).alias("_carry"),
            (F.col("_era") - (F.col("_breaks") > 0).cast("int") == 0).alias("_unbroken"),
        )
    )
    rows = marked.join(carried, [*ITEM, "_day"], "left")
    carry = F.col("_carry")
    if state is not None:
        initial = state.select(*ITEM, F.col("streak").alias("_initial"))
        rows = rows.join(initial, ITEM, "left")
        carry = carry + F.when(F.col("_unbroken"), F.coalesce("_initial", F.lit(0))).otherwise(0)
    streak = F.col("_before") + F.when(F.col("_resets") == 0, carry).otherwise(0)
    spare = [c for c in rows.columns if c.startswith("_")]
    return rows.withColumn("streak", streak.cast("int")).drop(*spare)
