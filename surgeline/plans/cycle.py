"""One cycle of all capacities: current readings in; events, alerts, actions and state out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tiers import NONE
from ..operators.baselines import baseline_history, baseline_join, compute_baselines
from ..operators.detect import advance_state, assess, cycle_gates, score, state_join
from ..operators.intervals import interval_pairing, intervals_from_pairs, with_cadence
from ..operators.outbox import (
    action_results,
    alert_outbox,
    event_projection,
    planned_actions,
    with_results,
)
from ..policy import policy_join


@dataclass(frozen=True)
class Cycle:
    intervals: DataFrame
    assessed: DataFrame
    results: DataFrame
    events: DataFrame
    alerts: DataFrame
    state: DataFrame


def run_cycle(
    current: DataFrame,
    previous: DataFrame,
    history: DataFrame,
    state: DataFrame,
    capacities: DataFrame,
    work: DataFrame,
    run_id: Column,
) -> Cycle:
    """`previous` are the readings before, `history` the intervals of earlier days. Baselines are
    built only for the buckets the current intervals fall into."""
    intervals = intervals_from_pairs(interval_pairing(current, previous))
    judged = with_cadence(policy_join(intervals, capacities)).filter("comparable")
    moment = judged.groupBy("capacity_key", "bucket").agg(F.max(F.to_date("window_end")).alias("_today"))
    past = with_cadence(policy_join(history, capacities)).join(moment, ["capacity_key", "bucket"])
    baselines = compute_baselines(baseline_history(past, F.col("_today")), capacities)
    scored = score(baseline_join(judged, baselines))
    gated = cycle_gates(assess(state_join(scored, state)))
    anomalies = gated.filter(F.col("tier") > NONE)
    results = action_results(planned_actions(anomalies), work)
    full = with_results(anomalies, results)
    return Cycle(
        intervals=intervals,
        assessed=gated,
        results=results,
        events=event_projection(full, run_id),
        alerts=alert_outbox(full),
        state=advance_state(gated),
    )
