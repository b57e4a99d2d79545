"""Robust consumption baselines per item and time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.robust import summarize, trim_top
from ..schemas import ITEM

BUCKET = [*ITEM, "bucket"]


def baseline_history(intervals: DataFrame, reference_day: Column) -> DataFrame:
    """Comparable intervals of earlier days within the lookback (needs `with_cadence`)."""
    age = F.datediff(reference_day, F.to_date("window_end"))
    lookback = F.col("policy")["baseline"]["lookback_days"]
    return intervals.filter(F.col("comparable") & (age >= 1) & (age <= lookback))


def _with_baseline(df: DataFrame) -> DataFrame:
    """Turn `_samples` and `_days` into struct <value, days, samples, method>, NULL if empty.

    Built column by column, so that the sorted and trimmed arrays are computed once each.
    """
    settings = F.col("policy")["baseline"]
    summary = F.struct(
        F.col("_value").alias("value"),
        F.col("_days").cast("int").alias("days"),
        F.size("_sorted").alias("samples"),
        settings["method"].alias("method"),
    )
    return (
        df.withColumn("_sorted", F.sort_array("_samples"))
        .withColumn("_kept", trim_top(F.col("_sorted"), settings["trim_top_percent"]))
        .withColumn("_value", summarize(F.col("_kept"), settings["method"]))
        .withColumn("baseline", F.when(F.size("_sorted") > 0, summary))
    )


def compute_baselines(history: DataFrame, capacities: DataFrame) -> DataFrame:
    """Baseline per item and bucket from rows that passed `baseline_history`.

    The samples of a group are collected because trimming needs them sorted. Their number is
    bounded: comparable intervals last at least interval/stretch minutes, so a bucket of one hour
    holds at most 60 * stretch / interval of them per day, over at most 90 days of lookback.
    """
    collected = history.groupBy(*BUCKET).agg(
        F.collect_list("normalized").alias("_samples"),
        F.collect_set(F.to_date("window_end")).alias("_days"),
    )
    collected = collected.withColumn("_days", F.size("_days"))
    joined = collected.join(capacities.select("capacity_key", "policy"), "capacity_key")
    return _with_baseline(joined).select(*BUCKET, "baseline")


def baseline_join(intervals: DataFrame, baselines: DataFrame) -> DataFrame:
    """Every interval with the baseline of its item and bucket, or NULL."""
    return intervals.join(baselines, BUCKET, "left")


def lookback_classes(capacities: DataFrame) -> list[int]:
    """The distinct lookbacks of the enabled capacities, a handful of numbers from configuration."""
    lookback = F.col("policy")["baseline"]["lookback_days"].alias("days")
    return sorted(r["days"] for r in capacities.filter("enabled").select(lookback).distinct().collect())


def replay_baselines(intervals: DataFrame, capacities: DataFrame) -> DataFrame:
    """For each comparable interval the baseline its own past gave it (1..lookback days before).

    All intervals of a day in a bucket share that past: a range frame over days gathers it once for
    all of them. The intervals are sorted once, after one shuffle, and only values are gathered. Each
    lookback that a policy asks for has a frame of its own, which collects nothing for the capacities
    of another: a capacity that looks back a week does not carry the quarter of its neighbour, and
    none is cut short. The item leads the sort, as it tells more rows apart than its capacity.
    """
    rest = [c for c in intervals.columns if c not in (*BUCKET, "policy", "sku", "cu_per_second")]
    by_day = Window.partitionBy("item_id", "bucket", "capacity_key").orderBy("_day")
    rows = (
        intervals.filter("comparable")
        .select(
            *BUCKET,
            *rest,
            F.col("policy")["baseline"]["lookback_days"].alias("_lookback"),
            F.unix_date(F.to_date("window_end")).alias("_day"),
        )
        .repartition(*BUCKET)
        .withColumn("_new_day", (~F.lag("_day").over(by_day).eqNullSafe(F.col("_day"))).cast("int"))
    )
    value, zero = F.col("normalized"), F.lit(0)
    collected, unknown, days = [F.array().cast("array<double>")], zero, zero
    for n in lookback_classes(capacities):
        own, past = F.col("_lookback") == n, by_day.rangeBetween(-n, -1)
        collected.append(F.collect_list(F.when(own, value)).over(past))
        unknown = unknown + F.count_if(own & value.isNull()).over(past)
        days = days + F.coalesce(F.sum(F.when(own, F.col("_new_day"))).over(past), zero)
    framed = rows.withColumns({"_known": F.concat(*collected), "_unknown": unknown.cast("int"), "_days": days})
    policies = capacities.filter("enabled").drop("capacity_id", "enabled")
    missing = F.array_repeat(F.lit(None).cast("double"), F.col("_unknown"))
    samples = F.when(F.col("_unknown") > 0, F.concat("_known", missing)).otherwise(F.col("_known"))
    joined = [c for c in policies.columns if c != "capacity_key"]
    recent = framed.join(policies, "capacity_key").withColumn("_samples", samples)
    return _with_baseline(recent).select(*BUCKET, "baseline", *joined, *rest)


# -- a history that grows batch by batch


def sampling_basis(policy: Column) -> Column:
    """The settings that stored samples depend on; under other settings they do not count."""
    return F.concat_ws(
        "|",
        policy["interval_minutes"].cast("string"),
        policy["baseline"]["bucket"],
        policy["guards"]["max_interval_stretch"].cast("string"),
    )


def day_samples(intervals: DataFrame) -> DataFrame:
    """Samples per item, bucket and day of comparable intervals (needs `with_cadence`), each with
    its time, by which one that is folded again is known."""
    key = [*BUCKET, F.to_date("window_end").alias("day"), sampling_basis(F.col("policy")).alias("basis")]
    return intervals.filter("comparable").groupBy(*key).agg(
        F.collect_list(F.struct(F.col("window_end").alias("at"), F.col("normalized").alias("value"))).alias("samples")
    )


def extend_baselines(fresh: DataFrame, stored: DataFrame, capacities: DataFrame) -> DataFrame:
    """`replay_baselines` for fresh intervals only, from the stored `day_samples` of earlier ones.

    Stored days are thinned to the fresh buckets before they move, and only days of fresh
    intervals meet them: what was judged before is not judged again. A stored day may be spread
    over several rows.
    """
    lookback = F.col("policy")["baseline"]["lookback_days"]
    judged = fresh.filter("comparable").withColumn("day", F.to_date("window_end"))
    wanted = judged.select(*BUCKET, "day", sampling_basis(F.col("policy")).alias("basis"), lookback.alias("_lookback")).distinct()
    own = day_samples(fresh).select(*BUCKET, "day", "basis", "samples")
    known = stored.select(*own.columns).join(wanted.select(*BUCKET, "basis").distinct(), [*BUCKET, "basis"], "left_semi")
    past = known.unionByName(own).withColumnRenamed("day", "_day")
    age = F.datediff("day", "_day")
    met = wanted.join(past, [*BUCKET, "basis"]).filter((age >= 1) & (age <= F.col("_lookback")))
    collected = met.groupBy(*BUCKET, "day").agg(
        F.flatten(F.collect_list("samples")).alias("_found"), F.count_distinct("_day").alias("_days")
    )
    collected = collected.withColumn("_samples", F.transform(F.array_distinct("_found"), lambda x: x["value"])).drop("_found")
    policies = capacities.filter("enabled").select("capacity_key", "policy")
    baselines = _with_baseline(collected.join(policies, "capacity_key")).select(*BUCKET, "day", "baseline")
    return judged.join(baselines, [*BUCKET, "day"], "left").drop("day")
