"""Operators on cumulative readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import chunk_of
from ..schemas import ITEM


def dedup_latest_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Last write per key wins. Each map task passes on one row per key (window group limit), so
    a key with very many copies does not travel."""
    ranked = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def latest_per_item(snapshots: DataFrame) -> DataFrame:
    """Newest reading of every item, with map-side combine."""
    rest = [c for c in snapshots.columns if c not in ITEM]
    newest = F.max_by(F.struct(*rest), F.col("ts")).alias("_newest")
    return snapshots.groupBy(*ITEM).agg(newest).select(*ITEM, "_newest.*")


def latest_row_number(snapshots: DataFrame) -> DataFrame:
    """The same through a ranking."""
    return dedup_latest_by_key(snapshots, ITEM, [F.desc("ts")])


def previous_snapshot(snapshots: DataFrame, before: Column) -> DataFrame:
    """Newest reading of every item strictly before a moment."""
    return latest_per_item(snapshots.filter(F.col("ts") < before))


def previous_reading(snapshots: DataFrame, chunk: str = "day") -> DataFrame:
    """Add the preceding reading of the item as `prev_ts` and `prev_cu`, NULL for the first.

    A plain lag over the item would sort all its history in one task. Instead the history is cut
    into calendar chunks: inside a chunk a lag, and the first reading of each chunk looks up the
    last one of the nearest earlier chunk. With (item, ts) unique at whole seconds a chunk of a
    day has at most 86,400 rows, and the second window sees one row per item and chunk. Both
    branches read one shared shuffle. Use a longer chunk where readings are daily or rarer. The item
    leads the sorts, as it tells more rows apart than its capacity.
    """
    within = Window.partitionBy("item_id", "capacity_key", "_chunk").orderBy("ts")
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    across = Window.partitionBy(*ITEM).orderBy("_chunk")
    chunked = (
        snapshots.withColumn("_chunk", chunk_of(F.col("ts"), chunk))
        .withColumn("prev_ts", F.lag("ts").over(within))
        .withColumn("prev_cu", F.lag("cu_seconds_today").over(within))
        .withColumn("_last_ts", F.last("ts").over(whole))
        .withColumn("_last_cu", F.last("cu_seconds_today").over(whole))
    )
    inner = chunked.filter(F.col("prev_ts").isNotNull())
    first = (
        chunked.filter(F.col("prev_ts").isNull())
        .withColumn("prev_ts", F.lag("_last_ts").over(across))
        .withColumn("prev_cu", F.lag("_last_cu").over(across))
    )
    return inner.unionByName(first).drop("_chunk", "_last_ts", "_last_cu")


def readings_as_of(moments: DataFrame, snapshots: DataFrame, chunk: str = "day") -> DataFrame:
    """Each item's newest reading strictly before each of many moments, as `prev_ts` and `prev_cu`,
    NULL where there is none. `moments` has the item, `moment` and whatever else.

    Moments and readings are merged in order of time, a moment before a reading of its own instant,
    and each moment takes the last reading so far. That runs within calendar chunks of an item; what
    a chunk inherits comes from one row per item and chunk. Equal moments of an item meet the
    readings once, so an item asked for very often costs no more than its distinct moments.
    """
    asked = moments.select(*ITEM, F.col("moment").alias("_at")).dropna().distinct()
    empty = [F.lit(None).cast("timestamp_ntz").alias("_ts"), F.lit(None).cast("double").alias("_cu")]
    read = snapshots.select(*ITEM, F.col("ts").alias("_at"), F.col("ts").alias("_ts"), F.col("cu_seconds_today").alias("_cu"))
    merged = read.unionByName(asked.select(*ITEM, "_at", *empty)).withColumn("_chunk", chunk_of(F.col("_at"), chunk))
    chunked = merged.repartition(*ITEM, "_chunk")
    so_far = (
        Window.partitionBy(*ITEM, "_chunk")
        .orderBy("_at", F.col("_ts").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = chunked.select(
        *ITEM, "_chunk", "_at", "_ts", F.last("_ts", True).over(so_far).alias("_own_ts"), F.last("_cu", True).over(so_far).alias("_own_cu")
    ).filter("_ts IS NULL")
    tails = chunked.groupBy(*ITEM, "_chunk").agg(F.max("_ts").alias("_tail_ts"), F.max_by("_cu", "_ts").alias("_tail_cu"))
    earlier = Window.partitionBy(*ITEM).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *ITEM, "_chunk", F.last("_tail_ts", True).over(earlier).alias("_carried_ts"), F.last("_tail_cu", True).over(earlier).alias("_carried_cu")
    )
    own = F.col("_own_ts").isNotNull()
    found = within.join(carried, [*ITEM, "_chunk"], "left").select(
        *ITEM,
        F.col("_at").alias("moment"),
        F.when(own, F.col("_own_ts")).otherwise(F.col("_carried_ts")).alias("prev_ts"),
        F.when(own, F.col("_own_cu")).otherwise(F.col("_carried_cu")).alias("prev_cu"),
    )
    return moments.join(found, [*ITEM, "moment"], "left")


def top_consumers(snapshots: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Largest consumers per group; the limit applies in every map task before the shuffle."""
    largest = Window.partitionBy(*by).orderBy(F.desc("cu_seconds_today"), "item_id")
    return snapshots.withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= limit)


def unmatched_capacities(capacities: DataFrame, visible: DataFrame) -> DataFrame:
    """Enabled capacities whose id is not among the visible ones, ignoring case."""
    seen = visible.select(F.lower("capacity_id").alias("_id")).distinct()
    return capacities.filter("enabled").join(seen, F.lower("capacity_id") == F.col("_id"), "left_anti")
