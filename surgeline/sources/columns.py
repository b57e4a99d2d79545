"""Bringing foreign column layouts and dirty rows to the snapshot schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical columns of a usage reading.
CANONICAL = ["item_id", "item_name", "item_kind", "workspace_id", "workspace_name", "cu_seconds_today"]

# Column aliases of the metrics model.
METRICS_ALIASES = {
    "Items[ItemId]": "item_id",
    "Items[ItemName]": "item_name",
    "Items[ItemKind]": "item_kind",
    "Items[WorkspaceId]": "workspace_id",
    "Items[WorkspaceName]": "workspace_name",
    "[cu_seconds_today]": "cu_seconds_today",
}


@dataclass(frozen=True)
class AliasProfile:
    """A known layout: what must exist for it to apply, and how its columns are called."""

    name: str
    tables: tuple[str, ...]
    columns: tuple[str, ...]
    aliases: dict[str, str]


# Known layouts in the order they are tried.
PROFILES = [
    AliasProfile(
        "fabric_metrics_v1",
        ("Items", "Capacities", "MetricsByItemandOperationandDay"),
        (
            "Items[ItemId]",
            "Items[WorkspaceId]",
            "Capacities[capacityId]",
            "MetricsByItemandOperationandDay[Date]",
            "MetricsByItemandOperationandDay[sum_CU]",
        ),
        METRICS_ALIASES,
    ),
    AliasProfile(
        "fabric_metrics_v2",
        ("Items", "Capacities", "MetricsByItemandOperationandDay"),
        ("Items[ItemId]", "Capacities[capacityId]", "MetricsByItemandOperationandDay[Date]"),
        METRICS_ALIASES,
    ),
    AliasProfile(
        "fabric_metrics_timepoints",
        ("Items", "Capacities", "TimePoints"),
        ("Items[ItemId]", "Capacities[capacityId]", "TimePoints[Date]"),
        METRICS_ALIASES,
    ),
]


def _plain(name: str) -> str:
    return name.translate(str.maketrans("", "", "[]")).strip().lower()


def resolve_column(name: str, aliases: dict[str, str]) -> str | None:
    """Canonical name of a foreign column: exact alias, then alias without brackets and case,
    then the canonical name itself."""
    if name in aliases:
        return aliases[name]
    loose = {_plain(a): c for a, c in reversed(aliases.items())}
    canonical = {c.lower(): c for c in CANONICAL}
    return loose.get(_plain(name)) or canonical.get(_plain(name))


def standardize_snapshots(
    df: DataFrame, aliases: dict[str, str] = METRICS_ALIASES, keep: list[str] | None = None
) -> DataFrame:
    """Rename known columns and drop the rest but `keep`. Resolved once, on the schema; if two
    columns claim one name, the later wins."""
    chosen: dict[str, str] = {}
    for name in df.columns:
        canonical = name if keep and name in keep else resolve_column(name, aliases)
        if canonical:
            chosen[canonical] = name
    return df.select(*[F.col(f"`{source}`").alias(target) for target, source in chosen.items()])


def pick_alias_profile(tables: list[str], columns: list[str]) -> AliasProfile | None:
    """First known layout whose tables and columns all exist, ignoring case."""
    have_tables = {t.lower() for t in tables}
    have_columns = {c.lower() for c in columns}
    for profile in PROFILES:
        needed_tables = {t.lower() for t in profile.tables}
        needed_columns = {c.lower() for c in profile.columns}
        if needed_tables <= have_tables and needed_columns <= have_columns:
            return profile
    return None


def _or_default(name: str, default: Column) -> Column:
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), default).alias(name)


def _reading(raw: Column) -> Column:
    """NULL and empty count as zero consumption; text that is no number stays NULL."""
    text = raw.cast("string")
    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(empty, F.lit(0.0)).otherwise(text.try_cast("double"))


def _readable(df: DataFrame) -> Column:
    has_item = F.coalesce(F.col("item_id").cast("string"), F.lit("")) != ""
    return has_item & _reading(F.col("cu_seconds_today")).isNotNull()


def clean_snapshots(df: DataFrame) -> DataFrame:
    """Drop rows without an item or with an unreadable consumption, fill the other blanks."""
    others = [c for c in df.columns if c not in CANONICAL]
    item = F.col("item_id").cast("string")
    return df.filter(_readable(df)).select(
        *others,
        item.alias("item_id"),
        _or_default("item_name", item),
        _or_default("item_kind", F.lit("Unknown")),
        _or_default("workspace_id", F.lit("")),
        _or_default("workspace_name", F.lit("")),
        _reading(F.col("cu_seconds_today")).alias("cu_seconds_today"),
    )


def quarantine_snapshots(df: DataFrame) -> DataFrame:
    """The rows `clean_snapshots` drops, kept apart so that one bad source never stops others."""
    return df.filter(~_readable(df))


def isolate(df: DataFrame) -> DataFrame:
    """Every row with a `reason` why it is no reading, NULL for a readable one. A source that marks
    broken records in `_corrupt_record` has them set aside too."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    broken = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in df.columns else F.lit(False)
    reason = (
        F.when(broken, "corrupt_record")
        .when(~given("capacity_key"), "no_capacity")
        .when(F.col("ts").cast("string").try_cast("timestamp_ntz").isNull(), "no_time")
        .when(~given("item_id"), "no_item")
        .when(_reading(F.col("cu_seconds_today")).isNull(), "unreadable_consumption")
    )
    return df.withColumn("reason", reason)


def failure_marks(isolated: DataFrame) -> DataFrame:
    """Unreadable rows of each capacity by reason, with how many of its rows could be read."""
    counts = isolated.groupBy("capacity_key", "reason").agg(F.count("*").alias("rows"))
    readable = counts.filter("reason IS NULL").select("capacity_key", F.col("rows").alias("_readable"))
    failed = counts.filter("reason IS NOT NULL").alias("f")
    joined = failed.join(readable.alias("r"), F.col("f.capacity_key").eqNullSafe(F.col("r.capacity_key")), "left")
    return joined.select("f.capacity_key", "reason", "rows", F.coalesce("_readable", F.lit(0)).alias("readable"))


def union_capacities(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack per-capacity frames, labelled with their capacity; missing columns become NULL."""
    labelled = [df.withColumn("capacity_key", F.lit(key)) for key, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
