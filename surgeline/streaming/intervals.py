"""Intervals from a stream of readings, with the last reading of each item carried over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.snapshots import dedup_latest_by_key
from ..schemas import ITEM, SNAPSHOTS
from ..session import materialize
from ..sources.tables import WatchTables
from .watch import fresh_intervals


def stream_intervals(snapshots: DataFrame, store: WatchTables, checkpoint: str, chunk: str = "day") -> DataStreamWriter:
    """Keeps the store's intervals up to date: the consumption since each item's previous reading.

    The first reading of an item yields nothing, one that is not newer than the last is ignored.
    A micro-batch is differenced by the batch operator, in calendar chunks, so that a backfill of
    one hot item is spread over tasks; all that is carried from batch to batch is one reading an
    item. A batch that is run again overwrites itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        newest = dedup_latest_by_key(batch.select(*SNAPSHOTS.names), [*ITEM, "ts"], [F.desc("cu_seconds_today")])
        readings = materialize(newest, "readings")
        store.write_intervals(fresh_intervals(readings, store.load_last_readings(before=number), chunk), number)
        store.save_last_readings(readings, number)

    return snapshots.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
