"""Cumulative readings from a stream of raw usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ITEM
from ..sources.usage import DESCRIBED, IDENTITY


def usage_stream_cumulative(usage: DataFrame, lateness: str | None = "1 day") -> DataFrame:
    """Running sum since midnight per item; write it in update mode.

    Each micro-batch yields the items it touched, with the newest usage time as reading time. The
    sums are combined before the shuffle. A day is forgotten once the watermark has passed its end
    by `lateness`; watermarks need an instant, so this asks for a UTC session, where naive local
    times convert without gaps. With None every day's sum stays in state for ever.
    """
    if lateness is None:
        keyed = usage.groupBy(*ITEM, F.to_date("ts").alias("day"))
    else:
        zone = usage.sparkSession.conf.get("spark.sql.session.timeZone")
        if zone not in ("UTC", "Etc/UTC", "GMT", "Z"):
            raise ValueError(f"a watermark needs a UTC session, not {zone}")
        timed = usage.withColumn("_instant", F.col("ts").cast("timestamp")).withWatermark("_instant", lateness)
        keyed = timed.groupBy(*ITEM, F.window("_instant", "1 day").alias("_window"))
    sums = keyed.agg(F.max(F.struct("ts", *DESCRIBED)).alias("_newest"), F.sum("cu_seconds").alias("cu_seconds_today"))
    described = sums.select(*ITEM, "_newest.*", "cu_seconds_today")
    return described.select("ts", *IDENTITY, "cu_seconds_today")
