"""Streaming operators as queries: the tables are fed through a stream in two portions, and what
the stream wrote is read back. The results must be those of the batch operators."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import naive
from ..operators.snapshots import dedup_latest_by_key
from ..schemas import ITEM, SNAPSHOTS, USAGE
from ..session import scratch_path
from ..sources.tables import WatchTables, expire_states
from ..streaming.intervals import stream_intervals as intervals_of_stream
from ..streaming.usage import usage_stream_cumulative as cumulative_of_stream
from ..streaming.watch import process_batch, watch
from . import fixture as fx
from .batch import ROW, _dirty, _scored, _show_events, _show_intervals, _state, query

PERIOD = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
HALFWAY = dt.datetime(2024, 1, 16)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS_CONF = "spark.sql.shuffle.partitions"


def _halves(rows: DataFrame) -> list[DataFrame]:
    cut = naive(HALFWAY)
    return [rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut)]


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the duration of a query."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _partitions(spark: SparkSession) -> str:
    """State partitions are fixed for a stream's life; a local session needs only its cores."""
    if spark.sparkContext.master.startswith("local"):
        return str(spark.sparkContext.defaultParallelism)
    return spark.conf.get(PARTITIONS_CONF)


def _feed(spark: SparkSession, portions: list[DataFrame], schema, start) -> None:
    """Append each portion to a folder and let the stream catch up before the next."""
    folder = scratch_path(spark, "stream-input")
    with _settings(spark, {PARTITIONS_CONF: _partitions(spark), PROVIDER_CONF: ROCKSDB}):
        for portion in portions:
            portion.select(*schema.names).write.mode("append").parquet(folder)
            started = start(spark.readStream.schema(schema).parquet(folder))
            started.awaitTermination()


@query
def usage_stream_cumulative(spark, d):
    """The last sum the stream showed for each item and day."""
    out = scratch_path(spark, "stream-output")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/version={number}")

    def start(stream: DataFrame):
        sums = cumulative_of_stream(stream)
        checkpoint = f"{out}-checkpoint"
        writer = sums.writeStream.outputMode("update").foreachBatch(keep)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    _feed(spark, _halves(fx.usage(spark, d)), USAGE, start)
    shown = spark.read.parquet(out).withColumn("day", F.to_date("ts"))
    newest = dedup_latest_by_key(shown, [*ITEM, "day"], [F.desc("batch")])
    return newest.select(*ITEM, "day", "cu_seconds_today")


@query
def stream_intervals(spark, d):
    store = WatchTables(spark, scratch_path(spark, "intervals"))
    checkpoint = scratch_path(spark, "intervals-checkpoint")

    def start(stream: DataFrame):
        return intervals_of_stream(stream, store, checkpoint).trigger(availableNow=True).start()

    _feed(spark, _halves(fx.snapshots(spark, d)), SNAPSHOTS, start)
    return _show_intervals(store.read_intervals(*PERIOD))


def _watched(spark, d) -> WatchTables:
    store = WatchTables(spark, scratch_path(spark, "watch"))
    checkpoint = scratch_path(spark, "watch-checkpoint")
    caps, listed = fx.capacities(spark), fx.work(spark, d)

    def start(stream: DataFrame):
        return watch(stream, store, caps, checkpoint, listed).trigger(availableNow=True).start()

    _feed(spark, _halves(fx.snapshots(spark, d)), SNAPSHOTS, start)
    return store


@query
def cycle(spark, d):
    """The audit events of a watched stream."""
    return _show_events(_watched(spark, d).read_events())


@query
def stream_gates(spark, d):
    """The item state a watched stream ends with."""
    return _watched(spark, d).load_states()


@query
def action_ledger(spark, d):
    """The actions a watched stream has planned. Its second half is then run once more under another
    number, from the state before it: the ledger lets nothing be planned twice."""
    store = _watched(spark, d)
    store.rewind(1)
    process_batch(_halves(fx.snapshots(spark, d))[1], 2, store, fx.capacities(spark), fx.work(spark, d))
    return store.read_actions().select(*ROW, "step", "action", "ok", "detail", "targets")


@query
def target_ledger(spark, d):
    """What the planned actions of a watched stream would stop."""
    return _watched(spark, d).read_targets().select(*ROW, "action", "target")


@query
def run_log(spark, d):
    """How the cycles of a watched stream went."""
    shown = ["run_id", "capacity_key", "mode", "window_end", "items_scanned", "anomalies", "actions_taken", "skipped_intervals", "bootstrap", "errors"]
    return _watched(spark, d).read_runs().select(*shown)


@query
def bootstrap(spark, d):
    """Cycles of a watched stream in which no item had an earlier reading yet."""
    return _watched(spark, d).read_runs().filter("bootstrap").select("capacity_key", "window_end", "items_scanned")


@query
def failure_isolation(spark, d):
    """Readings as unclean as they come go through the watch; what it set aside, and why."""
    store = WatchTables(spark, scratch_path(spark, "watch"))
    number = (F.col("event_id") % 3).cast("string")
    dirty = _dirty(spark, d).withColumns({"capacity_key": F.concat(F.lit("C"), number), "capacity_id": F.concat(F.lit("cap-"), number)})
    moment = fx.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    process_batch(dirty.join(moment, "event_id"), 0, store, fx.capacities(spark))
    row = lambda c: F.get_json_object("row", f"$.{c}").alias(c)
    return store.read_quarantine().select(row("event_id").cast("long").alias("event_id"), row("item_id"), row("cu_seconds_today"), "reason")


@query
def state_expiry(spark, d):
    """The states kept a week back, of items renamed every day."""
    daily = F.concat("item_id", F.lit("@"), F.to_date("window_end").cast("string"))
    return expire_states(_state(_scored(spark, d).withColumn("item_id", daily)), 7).select(*ITEM, "streak", "last_action_ts", "last_seen_ts")

