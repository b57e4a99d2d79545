"""Cooldown and budget over a whole history.

Both feed back on themselves: an action silences its item for a while, and a cycle that wants too
many actions gets none, which changes who is silent afterwards. Given the set of cycles that went
over budget, items no longer depend on each other, so that set is found first, in a fixed number of
jobs:

1. Only items that are ever eligible in a crowded cycle, one with more eligible items than its
   limit, can matter.
2. A crowded cycle is over budget for certain if enough of its items have not been eligible for a
   cooldown's length. Nobody acts in it, so its rows take no further part.
3. What remains of a capacity is cut into segments, wherever no item is eligible on both sides
   within its cooldown. What happened before a cut cannot matter after it.
4. Each segment is folded in time order as a stream. The fold holds the last actions younger than a
   cooldown and the acting items of one cycle, at most as many as the limit allows.

Then every item replays its own cooldown, given those cycles.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import naive, seconds_between
from ..schemas import CYCLE, ITEM
from ..session import materialize
from .detect import over_budget_cycles

_REPLAYED = (
    "capacity_key STRING, item_id STRING, window_end TIMESTAMP_NTZ, last_action_ts TIMESTAMP_NTZ, "
    "actionable BOOLEAN, over_budget BOOLEAN, _limit INT"
)


def _replay_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Carry each item's last action along rows sorted by item and time, batch after batch."""
    item, last = None, None
    for rows in batches:
        keys = list(zip(rows["capacity_key"], rows["item_id"]))
        at = rows["_second"].to_numpy(np.int64)
        initial = rows["_initial_second"].to_numpy(np.float64)
        quiet = rows["_cooldown_seconds"].to_numpy(np.float64)
        eligible = rows["eligible"].to_numpy(bool)
        over = rows["over_budget"].to_numpy(bool)
        before = np.full(len(rows), np.nan)
        acting = np.zeros(len(rows), dtype=bool)
        for i, key in enumerate(keys):
            if key != item:
                item, last = key, initial[i]
            before[i] = last
            # a comparison with NaN is False: no earlier action, no cooldown
            acting[i] = eligible[i] and not at[i] - last < quiet[i]
            if acting[i] and not over[i]:
                last = at[i]
        yield pd.DataFrame(
            {
                "capacity_key": rows["capacity_key"],
                "item_id": rows["item_id"],
                "window_end": rows["window_end"],
                "last_action_ts": pd.to_datetime(pd.Series(before, index=rows.index), unit="s"),
                "actionable": acting,
                "over_budget": over,
                "_limit": rows["_limit"],
            }
        )


def _replay_items(rows: DataFrame, over: DataFrame) -> DataFrame:
    """Replay every item on its own, given the cycles that are over budget."""
    known = rows.join(over.withColumn("_over", F.lit(True)), CYCLE, "left").withColumn(
        "over_budget", F.coalesce("_over", F.lit(False))
    )
    inputs = known.select(
        *ITEM, "window_end", "_second", "_initial_second", "_cooldown_seconds", "eligible",
        "over_budget", "_limit",
    )
    ordered = inputs.repartition(*ITEM).sortWithinPartitions(*ITEM, "_second")
    return ordered.mapInPandas(_replay_partition, _REPLAYED)


def replay_cooldowns(rows: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Last action before each row and whether its cycle went over budget.

    `rows` are anomalies with `eligible` (every other gate lets them act), `cooldown_minutes` and
    `max_actions`. Returns the item, `window_end`, `last_action_ts`, `actionable` and
    `over_budget`. An item has one row per cycle at most and is streamed through its task, so
    memory does not grow with its history.
    """
    epoch = naive(dt.datetime(1970, 1, 1))
    timed = rows.select(
        *ITEM,
        "window_end",
        seconds_between(epoch, F.col("window_end")).cast("long").alias("_second"),
        (F.col("cooldown_minutes") * 60.0).alias("_cooldown_seconds"),
        "eligible",
        F.col("max_actions").cast("int").alias("_limit"),
    )
    initial = F.lit(None).cast("double")
    if state is not None:
        carried = state.select(*ITEM, seconds_between(epoch, F.col("last_action_ts")).alias("_carried"))
        timed = timed.join(carried, ITEM, "left")
        initial = F.col("_carried")
    timed = materialize(timed.withColumn("_initial_second", initial).drop("_carried"), "cooldown-rows")
    return _replay_items(timed, _settle_over_budget(timed))


def _settle_over_budget(timed: DataFrame) -> DataFrame:
    """The cycles over budget."""
    eligible = timed.filter("eligible")
    linked = eligible.join(over_budget_cycles(eligible), CYCLE, "left_semi").select(*ITEM).distinct()
    rows = materialize(eligible.join(linked, ITEM, "left_semi"), "cooldown-linked")
    certain = materialize(_certain_cycles(rows), "cooldown-certain")
    doubtful = materialize(_segments(rows.join(certain, CYCLE, "left_anti")), "cooldown-segments")
    by = ["capacity_key", "_segment"]
    ordered = doubtful.repartition(*by).sortWithinPartitions(*by, "_second")
    folded = ordered.mapInPandas(_fold_partition, "capacity_key STRING, window_end TIMESTAMP_NTZ")
    return materialize(certain.unionByName(folded), "over-budget")


def _certain_cycles(rows: DataFrame) -> DataFrame:
    """Cycles with more items than the limit that no earlier action can have silenced."""
    history = Window.partitionBy(*ITEM).orderBy("_second")
    before = F.greatest(F.lag("_second").over(history).cast("double"), F.col("_initial_second"))
    silent = F.coalesce(F.col("_second") - before < F.col("_cooldown_seconds"), F.lit(False))
    return over_budget_cycles(rows.withColumn("_silent", silent).filter("not _silent"))


def _segments(rows: DataFrame) -> DataFrame:
    """The rows of segments that hold a crowded cycle, with their segment and whether their own
    cycle is crowded. The windows run over an item's rows and a capacity's cycles, so their length
    is the calendar's, whatever the number of items."""
    history = Window.partitionBy(*ITEM).orderBy("_second")
    near = lambda a, b, quiet: F.coalesce(a - b < quiet, F.lit(False)).cast("int")
    at, quiet = F.col("_second"), F.col("_cooldown_seconds")
    ties = near(F.lead("_second").over(history), at, F.lead(quiet).over(history)) - near(at, F.lag("_second").over(history), quiet)
    cycles = rows.withColumn("_ties", ties).groupBy(*CYCLE, "_second").agg(
        F.sum("_ties").alias("_ties"), (F.count("*") > F.max("_limit")).alias("_crowded")
    )
    calendar = Window.partitionBy("capacity_key").orderBy("_second")
    whole = Window.partitionBy("capacity_key", "_segment")
    cut = (F.lag("_open").over(calendar) == 0).cast("int")
    numbered = (
        cycles.withColumn("_open", F.sum("_ties").over(calendar))
        .withColumn("_segment", F.coalesce(F.sum(cut).over(calendar), F.lit(0)))
        .withColumn("_matters", F.max("_crowded").over(whole))
        .filter("_matters")
    )
    return rows.join(numbered.select(*CYCLE, "_segment", "_crowded"), CYCLE)


def _fold_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cycles over budget of each segment. A crowded cycle keeps at most one acting item more
    than its limit in memory."""
    segment = cycle = None
    last: dict[str, float] = {}
    acting: list[str] = []
    tidy_at = 1024

    def settle() -> list[tuple]:
        capacity, at, end, crowded, limit = cycle
        if crowded and len(acting) > limit:
            return [(capacity, end)]
        last.update(dict.fromkeys(acting, at))
        return []

    for rows in batches:
        over = []
        columns = ("capacity_key", "_segment", "_second", "window_end", "item_id", "_initial_second", "_cooldown_seconds", "_crowded", "_limit")
        for capacity, number, at, end, item, initial, quiet, crowded, limit in zip(*(rows[c] for c in columns)):
            if cycle is None or cycle[0] != capacity or cycle[1] != at or segment != (capacity, number):
                over += settle() if cycle else []
                acting.clear()
                if segment != (capacity, number):
                    segment = capacity, number
                    last.clear()
                if len(last) > tidy_at:
                    for old in [k for k, v in last.items() if at - v >= quiet]:
                        del last[old]
                    tidy_at = max(1024, 2 * len(last))
                cycle = capacity, at, end, crowded, limit
            # a comparison with NaN is False: no earlier action, no cooldown
            if (not crowded or len(acting) <= limit) and not at - last.get(item, initial) < quiet:
                acting.append(item)
        if over:
            yield pd.DataFrame(over, columns=["capacity_key", "window_end"])
    if cycle and (over := settle()):
        yield pd.DataFrame(over, columns=["capacity_key", "window_end"])
