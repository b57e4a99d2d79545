"""Threshold calibration from a replayed history.

Input is the output of `score(replay_baselines(...))`: every comparable interval of the period,
with the baseline its past gave it. Protection, freezes, streaks and budgets play no part here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.robust import nearest_index
from ..schemas import ITEM
from ..session import materialize
from .ranks import percentile_nearest, select_ranks

# Suggestion quantiles, floors and steps; noise and history limits.
ALERT_QUANTILE, THROTTLE_QUANTILE, KILL_QUANTILE = 0.95, 0.99, 0.995
ALERT_FLOOR, THROTTLE_STEP, KILL_STEP = 1.2, 0.2, 0.3
ITEM_QUANTILE = 0.95
NOISY_BREACHES, NOISY_ITEMS = 3, 10
ENOUGH_DAYS = 7
KILL_WEIGHT = 100
TOP_PROFILES = 15

TIER_NAMES = ("alert", "throttle", "kill")

# What the statistics read of a scored interval, besides its capacity's policy.
READ = [*ITEM, "item_name", "item_kind", "window_end", "normalized", "baseline", "ratio"]


def _usable() -> Column:
    p, baseline = F.col("policy"), F.col("baseline")
    enough = (baseline["days"] >= p["baseline"]["min_days"]) & (F.col("normalized") >= p["guards"]["min_cu_seconds"])
    return F.coalesce(F.col("ratio").isNotNull() & enough, F.lit(False))


def usable_ratios(scored: DataFrame) -> DataFrame:
    """Intervals that would have been judged: enough days, trusted baseline, enough consumption."""
    return scored.filter(_usable())


def _breaches(usable: Column) -> list[Column]:
    steps = F.col("policy")["thresholds"]
    return [F.count_if(usable & (F.col("ratio") >= steps[t])).alias(t) for t in TIER_NAMES]


def item_profile(scored: DataFrame) -> DataFrame:
    """Samples, median and p95 consumption, highest ratio and breaches of every item."""
    usable = _usable()
    named = scored.groupBy(*ITEM, "item_name", "item_kind").agg(  # names as keys: no interval is sorted
        F.min("window_end").alias("_first"),
        F.count("*").alias("samples"),
        F.max(F.when(usable, F.col("ratio"))).alias("max_ratio"),
        *_breaches(usable),
    )
    counts = named.groupBy(*ITEM).agg(
        F.min_by("item_name", "_first").alias("item_name"),
        F.min_by("item_kind", "_first").alias("item_kind"),
        F.sum("samples").alias("samples"),
        F.coalesce(F.max("max_ratio"), F.lit(0.0)).alias("max_ratio"),
        *[F.sum(t).alias(t) for t in TIER_NAMES],
    )
    ranks = select_ranks(
        scored,
        ITEM,
        "normalized",
        {
            "_low": lambda n: F.floor((n - 1) / 2),
            "_high": lambda n: F.floor(n / 2),
            "p95_cu": lambda n: nearest_index(n, ITEM_QUANTILE),
        },
    )
    return counts.join(ranks, ITEM).select(
        *ITEM,
        "item_name",
        "item_kind",
        "samples",
        ((F.col("_low") + F.col("_high")) / 2.0).alias("median_cu"),
        "p95_cu",
        "max_ratio",
        *TIER_NAMES,
    )


def exposure() -> Column:
    return F.col("kill") * KILL_WEIGHT + F.col("max_ratio")


def rank_profiles(profiles: DataFrame, top: int = TOP_PROFILES) -> DataFrame:
    """The items of each capacity that are most exposed to action."""
    worst = Window.partitionBy("capacity_key").orderBy(exposure().desc(), "item_id")
    return profiles.withColumn("rank", F.row_number().over(worst)).filter(F.col("rank") <= top)


def noisy_items(profiles: DataFrame) -> DataFrame:
    """Names of the (at most ten) items that would have been acted on time and again."""
    noisy = rank_profiles(profiles.filter(F.col("throttle") >= NOISY_BREACHES), NOISY_ITEMS)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "item_name")))
    return noisy.groupBy("capacity_key").agg(F.transform(ordered, lambda x: x["item_name"]).alias("noisy_items"))


TAIL = {"_p95": ALERT_QUANTILE, "_p99": THROTTLE_QUANTILE, "_p995": KILL_QUANTILE}


def suggest_thresholds(usable: DataFrame, capacities: DataFrame) -> DataFrame:
    """Thresholds from the upper tail of the ratios; the current ones where there are none."""
    return _thresholds(percentile_nearest(usable, ["capacity_key"], "ratio", TAIL), capacities)


def _thresholds(tail: DataFrame, capacities: DataFrame) -> DataFrame:
    steps = F.col("policy")["thresholds"]
    alert = F.round(F.greatest(F.lit(ALERT_FLOOR), F.col("_p95")), 2)
    throttle = F.round(F.greatest(F.col("_alert") + THROTTLE_STEP, F.col("_p99")), 2)
    kill = F.round(F.greatest(F.col("_throttle") + KILL_STEP, F.col("_p995")), 2)
    found = tail.withColumn("_alert", alert).withColumn("_throttle", throttle).withColumn("_kill", kill)
    current = capacities.filter("enabled").select("capacity_key", "policy")
    return current.join(found, "capacity_key", "left").select(
        "capacity_key",
        F.coalesce("_alert", steps["alert"]).alias("suggested_alert"),
        F.coalesce("_throttle", steps["throttle"]).alias("suggested_throttle"),
        F.coalesce("_kill", steps["kill"]).alias("suggested_kill"),
    )


def suggest_min_cu(scored: DataFrame) -> DataFrame:
    """Median consumption of an interval (nearest rank), in whole units."""
    return _min_cu(percentile_nearest(scored, ["capacity_key"], "normalized", {"_p50": 0.5}))


def _min_cu(middle: DataFrame) -> DataFrame:
    return middle.select("capacity_key", F.bround("_p50").alias("suggested_min_cu"))


def _suggestions(scored: DataFrame, capacities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both suggestions from one selection over rows of (capacity, metric, value)."""
    ratio = F.when(_usable(), F.col("ratio"))
    metrics = F.array(F.struct(F.lit("ratio").alias("metric"), ratio.alias("value")), F.struct(F.lit("cu").alias("metric"), F.col("normalized").alias("value")))
    stacked = scored.select("capacity_key", F.inline(metrics))
    ranks = materialize(percentile_nearest(stacked, ["capacity_key", "metric"], "value", TAIL | {"_p50": 0.5}), "quantiles")
    return _thresholds(ranks.filter("metric = 'ratio'"), capacities), _min_cu(ranks.filter("metric = 'cu'"))


def days_seen(scored: DataFrame) -> DataFrame:
    days = F.count_distinct(F.to_date("window_end"))
    return scored.groupBy("capacity_key").agg(
        days.alias("days_of_history"), (days < ENOUGH_DAYS).alias("unstable")
    )


def calibration_report(
    scored: DataFrame, discarded: DataFrame, profiles: DataFrame, capacities: DataFrame
) -> DataFrame:
    """One row per enabled capacity. Without history: zeros and the current settings.

    `discarded` is the output of `discard_count`, which also tells capacities without any interval
    from those whose intervals were all incomparable.
    """
    usable = _usable()
    totals = scored.groupBy("capacity_key").agg(
        F.count("*").alias("total_intervals"),
        F.count_distinct(F.to_date("window_end")).alias("days_of_history"),
        *[would.alias(f"would_{t}") for t, would in zip(TIER_NAMES, _breaches(usable), strict=True)],
    )
    thresholds, min_cus = _suggestions(scored, capacities)
    key = "capacity_key"
    joined = capacities.filter("enabled").select(key, "policy").join(discarded, key, "left")
    for part in (totals, thresholds, min_cus, noisy_items(profiles)):
        joined = joined.join(part, key, "left")
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<string>")
    no_history = F.col("intervals").isNull()
    days = F.coalesce("days_of_history", zero)
    notes = F.array_compact(
        F.array(
            F.when(no_history, F.lit("no_history")),
            F.when(F.col("discarded") > 0, F.concat(F.lit("discarded_intervals:"), F.col("discarded").cast("string"))),
            F.when(F.col("noisy_items").isNotNull(), F.lit("noisy_items")),
            F.when(~no_history & (days < ENOUGH_DAYS), F.concat(F.lit("few_days:"), days.cast("string"))),
        )
    )
    min_cu = F.when(no_history, F.col("policy")["guards"]["min_cu_seconds"]).otherwise(
        F.coalesce("suggested_min_cu", F.lit(0.0))
    )
    return joined.select(
        key,
        days.alias("days_of_history"),
        F.coalesce("total_intervals", zero).alias("total_intervals"),
        *[F.coalesce(f"would_{t}", zero).alias(f"would_{t}") for t in TIER_NAMES],
        *[f"suggested_{t}" for t in TIER_NAMES],
        min_cu.alias("suggested_min_cu"),
        F.coalesce("noisy_items", empty).alias("noisy_items"),
        notes.alias("notes"),
    )
