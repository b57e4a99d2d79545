"""The tables of a running watch, as plain Parquet under one folder.

Rows that belong to a batch are written into `day=/batch=` partitions; writing a batch again replaces
just its partitions, so a retried batch leaves no duplicates. Reads of a period name its days, so their
cost does not grow with the table's age. Item state is small per item but changes as a whole: each batch
writes a complete version beside the one before, and drops older ones.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import calendar_parts, naive
from ..operators.snapshots import dedup_latest_by_key, latest_per_item
from ..schemas import (
    ACTIONS, ALERTS, EVENTS, FAILURES, INTERVALS, ITEM, ITEM_STATE, QUARANTINE, RUNS, SAMPLES, SNAPSHOTS, TARGETS, WHOLE, record,
)
from ..session import materialize


def _stored(schema: T.StructType, **extra: T.DataType) -> T.StructType:
    added = record(**extra, day=T.DateType(), batch=T.LongType())
    return T.StructType(schema.fields + added.fields)


def with_calendar(intervals: DataFrame) -> DataFrame:
    """Add `day`, `hour` and `dow` of the interval's end, as the table stores them."""
    return intervals.select("*", *calendar_parts(F.col("window_end")))


def load_intervals(
    intervals: DataFrame,
    since: dt.date,
    until: dt.date,
    capacity_key: str | None = None,
    hours: list[int] | None = None,
) -> DataFrame:
    """Intervals of `since <= day < until`. On the stored table `day` prunes partitions and the
    other conditions reach the Parquet reader."""
    chosen = intervals.filter((F.col("day") >= F.lit(since)) & (F.col("day") < F.lit(until)))
    if capacity_key is not None:
        chosen = chosen.filter(F.col("capacity_key") == capacity_key)
    return chosen.filter(F.col("hour").isin(hours)) if hours else chosen


def merge_states(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert by item: a changed item takes all its new values, the others stay."""
    values = [c for c in ITEM_STATE.names if c not in ITEM]
    old = current.select(*ITEM, F.struct(*values).alias("_old"))
    new = changes.select(*ITEM, F.struct(*values).alias("_new"))
    merged = old.join(new, ITEM, "full_outer").select(*ITEM, F.coalesce("_new", "_old").alias("_state"))
    return merged.select(*ITEM, "_state.*")


def retained_snapshots(snapshots: DataFrame, cutoff: dt.datetime) -> DataFrame:
    return snapshots.filter(F.col("ts") >= naive(cutoff))


def expire_states(state: DataFrame, ttl_days: int) -> DataFrame:
    """Forget items not seen for longer than `ttl_days` before the newest sighting of any."""
    newest = state.agg(F.max("last_seen_ts")).scalar()
    return state.filter(F.col("last_seen_ts") >= newest - F.make_dt_interval(F.lit(ttl_days)))


class WatchTables:
    """Reads and writes the tables under `root`, a folder all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- batches

    def _write_batch(self, df: DataFrame, table: str, batch: int) -> None:
        # rebalanced by day: neither many small files for many days nor one task for a full day
        (
            df.withColumn("batch", F.lit(batch).cast("bigint"))
            .hint("rebalance", "day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "batch")
            .parquet(f"{self.root}/{table}")
        )

    def _read(self, table: str, schema: T.StructType, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        """A table, or the days of `since <= day < until`; other days are not even listed."""
        days = [n for n in self._children(table) if n.startswith("day=")]
        if since is not None:
            days = [n for n in days if n[4:] >= since.isoformat()]
        if until is not None:
            days = [n for n in days if n[4:] < until.isoformat()]
        stored = _stored(schema)
        if not days:
            return self.spark.createDataFrame([], stored)
        root = f"{self.root}/{table}"
        paths = [root] if since is until is None else [f"{root}/{n}" for n in days]
        return self.spark.read.schema(stored).option("basePath", root).parquet(*paths)

    def write_snapshots(self, snapshots: DataFrame, batch: int = 0) -> None:
        rows = snapshots.select(*SNAPSHOTS.names, F.to_date("ts").alias("day"))
        self._write_batch(rows, "snapshots", batch)

    def read_snapshots(self) -> DataFrame:
        """Last write per item and time wins."""
        rows = self._read("snapshots", SNAPSHOTS)
        return dedup_latest_by_key(rows, [*ITEM, "ts"], [F.desc("batch")]).select(*SNAPSHOTS.names)

    def write_intervals(self, intervals: DataFrame, batch: int = 0) -> None:
        self._write_batch(with_calendar(intervals.select(*INTERVALS.names)), "intervals", batch)

    def read_intervals(
        self,
        since: dt.date,
        until: dt.date,
        capacity_key: str | None = None,
        hours: list[int] | None = None,
        before: int | None = None,
    ) -> DataFrame:
        """Last write per item and time wins; `before` leaves out a batch and all later ones."""
        rows = self._read("intervals", T.StructType([*INTERVALS.fields, *record(hour=WHOLE, dow=WHOLE).fields]), since, until)
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        chosen = load_intervals(rows, since, until, capacity_key, hours)
        key = [*ITEM, "window_end"]
        return dedup_latest_by_key(chosen, key, [F.desc("batch")]).drop("batch")

    def write_samples(self, samples: DataFrame, batch: int = 0) -> None:
        self._write_batch(samples.select(*SAMPLES.names, "day"), "samples", batch)

    def read_samples(self, since: dt.date, until: dt.date, before: int | None = None) -> DataFrame:
        """Day samples as the batches wrote them; a day's may be spread over several."""
        rows = self._read("samples", SAMPLES, since, until)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def write_events(self, events: DataFrame, batch: int = 0) -> None:
        self._write_batch(events.withColumn("day", F.to_date("ts")), "events", batch)

    def read_events(self) -> DataFrame:
        return self._read("events", EVENTS).select(*EVENTS.names)

    def write_alerts(self, alerts: DataFrame, batch: int = 0) -> None:
        self._write_batch(alerts.withColumn("day", F.to_date("window_end")), "alerts", batch)

    def read_alerts(self) -> DataFrame:
        return self._read("alerts", ALERTS).select(*ALERTS.names)

    # -- what was planned, and how runs went

    def not_yet_planned(self, plan: DataFrame, batch: int, since: dt.date, until: dt.date) -> DataFrame:
        """The planned actions that no other batch has in its ledger: whatever is replayed, under
        whatever number, an action is planned once."""
        others = self._read("actions", ACTIONS, since, until).filter(F.col("batch") != batch)
        return plan.join(others, [*ITEM, "window_end", "action"], "left_anti")

    def write_actions(self, results: DataFrame, batch: int = 0) -> None:
        self._write_batch(results.select(*ACTIONS.names, F.to_date("window_end").alias("day")), "actions", batch)

    def read_actions(self) -> DataFrame:
        return self._read("actions", ACTIONS).select(*ACTIONS.names)

    def write_targets(self, targets: DataFrame, batch: int = 0) -> None:
        self._write_batch(targets.select(*TARGETS.names, F.to_date("window_end").alias("day")), "targets", batch)

    def read_targets(self) -> DataFrame:
        return self._read("targets", TARGETS).select(*TARGETS.names)

    def write_runs(self, runs: DataFrame, batch: int = 0) -> None:
        self._write_batch(runs.select(*RUNS.names, F.to_date("window_end").alias("day")), "runs", batch)

    def read_runs(self) -> DataFrame:
        return self._read("runs", RUNS).select(*RUNS.names)

    def write_quarantine(self, rows: DataFrame, failures: DataFrame, day: dt.date, batch: int = 0) -> None:
        """Unreadable rows and their counts, under the day the batch ran: their own may be unknown."""
        today = F.lit(day).alias("day")
        self._write_batch(rows.select(*QUARANTINE.names, today), "quarantine", batch)
        self._write_batch(failures.select(*FAILURES.names, today), "failures", batch)

    def read_quarantine(self) -> DataFrame:
        return self._read("quarantine", QUARANTINE).select(*QUARANTINE.names)

    def read_failures(self) -> DataFrame:
        return self._read("failures", FAILURES).select(*FAILURES.names)

    # -- state versions

    def _load_version(self, table: str, schema: T.StructType, before: int | None) -> DataFrame:
        versions = [v for v in self._versions(table) if before is None or v < before]
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/version={max(versions)}")

    def _save_version(self, rows: DataFrame, table: str, batch: int) -> None:
        """A complete version. The one before stays for a batch that is run again."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/version={batch}")
        for old in sorted(v for v in self._versions(table) if v < batch)[:-1]:
            self._delete(table, f"version={old}")

    def load_states(self, before: int | None = None) -> DataFrame:
        """The newest complete version, or the newest one before a batch."""
        return self._load_version("item_state", ITEM_STATE, before)

    def save_states(self, changes: DataFrame, batch: int = 0, ttl_days: int | None = None) -> None:
        """Write the version of a batch: the one before it with the changes merged in."""
        merged = merge_states(self.load_states(before=batch), changes)
        if ttl_days is not None:
            merged = expire_states(merged, ttl_days)
        self._save_version(merged, "item_state", batch)

    def load_last_readings(self, before: int | None = None) -> DataFrame:
        return self._load_version("last_readings", SNAPSHOTS, before)

    def save_last_readings(self, readings: DataFrame, batch: int) -> None:
        """Newest reading of every item, so that a cycle need not search all snapshots."""
        rows = self.load_last_readings(before=batch).unionByName(readings.select(*SNAPSHOTS.names))
        self._save_version(latest_per_item(rows).select(*SNAPSHOTS.names), "last_readings", batch)

    def rewind(self, batch: int) -> None:
        """Forget what a batch and later ones left as state, as a restored backup would."""
        for table in ("item_state", "last_readings"):
            for version in self._versions(table):
                if version >= batch:
                    self._delete(table, f"version={version}")

    # -- retention

    def prune_snapshots(self, cutoff: dt.datetime) -> int:
        """Drop snapshots before a moment; intervals and events stay. Returns how many went.

        Days before the cutoff's are dropped whole. The cutoff's own day is written again without
        its earlier rows, batch by batch, in place.
        """
        rows = self._read("snapshots", SNAPSHOTS, until=cutoff.date() + dt.timedelta(days=1))
        gone = rows.filter(F.col("ts") < naive(cutoff)).select(*ITEM, "ts").distinct().count()
        if gone:
            day = f"day={cutoff.date().isoformat()}"
            kept = materialize(rows.filter(F.col("ts") >= naive(cutoff)), "kept-snapshots")
            left = {r["batch"] for r in kept.select("batch").distinct().collect()}  # the day's batches
            for batch in left:
                self._write_batch(kept.filter(F.col("batch") == batch).drop("batch"), "snapshots", batch)
            for name in self._children("snapshots", day):
                if name.startswith("batch=") and int(name[6:]) not in left:
                    self._delete("snapshots", day, name)
        for name in self._children("snapshots"):
            if name.startswith("day=") and name[4:] < cutoff.date().isoformat():
                self._delete("snapshots", name)
        return gone

    # -- folders

    def _fs(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, *parts: str) -> bool:
        fs, path = self._fs(*parts)
        return fs.exists(path)

    def _delete(self, *parts: str) -> None:
        fs, path = self._fs(*parts)
        fs.delete(path, True)

    def _children(self, *parts: str) -> list[str]:
        fs, path = self._fs(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _versions(self, table: str) -> list[int]:
        names = [n for n in self._children(table) if n.startswith("version=")]
        return [int(n[8:]) for n in names if self._exists(table, n, "_SUCCESS")]
