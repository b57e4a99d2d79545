"""Replay of a whole history: every capacity, item and cycle in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiers import ALERT, NONE, THROTTLE, tier_label
from ..operators.baselines import extend_baselines, replay_baselines
from ..operators.cooldown import replay_cooldowns
from ..operators.detect import assess, cycle_holds, dropped, idle_cycles, score, with_streak
from ..operators.intervals import derive_intervals, with_cadence
from ..policy import policy_join
from ..schemas import CYCLE, ITEM
from ..session import materialize


@dataclass(frozen=True)
class Replay:
    """`scored` has every comparable interval; `anomalies` those above a threshold, gated;
    `verdicts` the item, cycle, tier, streak and action of every comparable interval."""

    scored: DataFrame
    anomalies: DataFrame
    verdicts: DataFrame


def score_intervals(intervals: DataFrame, capacities: DataFrame) -> DataFrame:
    """Every comparable interval against the baseline its own past gave it."""
    cadenced = with_cadence(policy_join(intervals, capacities))
    return score(replay_baselines(cadenced, capacities))


def score_fresh(fresh: DataFrame, stored: DataFrame, capacities: DataFrame) -> DataFrame:
    """The same for fresh intervals alone, against stored day samples."""
    cadenced = with_cadence(policy_join(fresh, capacities))
    return score(extend_baselines(cadenced, stored, capacities))


def score_history(snapshots: DataFrame, capacities: DataFrame, chunk: str = "day") -> DataFrame:
    return score_intervals(derive_intervals(snapshots, chunk), capacities)


def gate_history(
    scored: DataFrame, capacities: DataFrame, state: DataFrame | None = None
) -> Replay:
    """Streaks, gates, cooldown and budget over all cycles, continuing from an earlier state.

    The scored history is written once without its policy, which is joined back where needed.
    From then on only narrow columns of all rows, or all columns of the few anomalies, move.
    """
    attached = [c for c in ("policy", "sku", "cu_per_second") if c in scored.columns]
    stored = materialize(scored.drop(*attached), "scored")
    streaks = with_streak(stored.select(*ITEM, "window_end", "tier"), state)
    verdicts = materialize(streaks, "streaks")

    anomalies = stored.filter(F.col("tier") > NONE)
    breaches = verdicts.filter(F.col("tier") > NONE).select(*ITEM, "window_end", "streak")
    used = policy_join(stored.select(*CYCLE, "cu_seconds", "minutes"), capacities)
    judged = (
        policy_join(anomalies.join(breaches, [*ITEM, "window_end"]), capacities)
        .join(idle_cycles(used), CYCLE, "left")
        .withColumn("last_action_ts", F.lit(None).cast("timestamp_ntz"))
    )
    guards = F.col("policy")["guards"]
    idle = F.coalesce("idle", F.lit(False))
    rows = assess(judged).filter(~dropped(F.col("suppressions"))).select(
        *ITEM,
        "window_end",
        ((F.col("effective_tier") >= THROTTLE) & ~idle).alias("eligible"),
        guards["cooldown_minutes"].alias("cooldown_minutes"),
        guards["max_actions_per_run"].alias("max_actions"),
    )
    replayed = materialize(replay_cooldowns(rows, state), "cooldowns")
    dynamic = replayed.select(*ITEM, "window_end", F.col("last_action_ts").alias("_last"), "actionable", "over_budget")
    timed = (
        judged.join(dynamic, [*ITEM, "window_end"], "left")
        .withColumn("last_action_ts", F.col("_last"))
        .drop("_last")
    )
    gated = cycle_holds(assess(timed), idle, F.col("actionable") & F.col("over_budget"))
    acted = replayed.filter(F.col("actionable") & ~F.col("over_budget")).select(
        *ITEM, "window_end", F.lit(True).alias("_acted")
    )
    verdicts = verdicts.join(acted, [*ITEM, "window_end"], "left").withColumn(
        "acted", F.coalesce("_acted", F.lit(False))
    ).drop("_acted")
    return Replay(stored, gated.drop("idle", "actionable", "over_budget"), verdicts)


def final_state(verdicts: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """State after the last cycle of each item, combined map-side."""
    last = verdicts.groupBy(*ITEM).agg(
        F.max_by(F.struct("tier", "streak"), "window_end").alias("_last"),
        F.max(F.when(F.col("acted"), F.col("window_end"))).alias("last_action_ts"),
        F.max("window_end").alias("last_seen_ts"),
    )
    tier, before = F.col("_last.tier"), F.col("_last.streak")
    action = F.col("last_action_ts")
    if state is not None:
        last = last.join(state.select(*ITEM, F.col("last_action_ts").alias("_earlier")), ITEM, "left")
        action = F.coalesce("last_action_ts", "_earlier")
    return last.select(
        *ITEM,
        F.when(tier >= ALERT, before + 1).otherwise(0).cast("int").alias("streak"),
        tier_label(tier).alias("last_tier"),
        action.alias("last_action_ts"),
        "last_seen_ts",
    )
