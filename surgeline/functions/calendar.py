"""Calendar and clock expressions on naive local timestamps (TIMESTAMP_NTZ).

Nothing here may cast to TIMESTAMP: that would bring in the session zone and, with it, hours
that repeat or vanish at daylight-saving changes.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F


def naive(moment: dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal. `lit` of a datetime is an instant, which a cast would then move by
    the session zone; text is taken as written."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Via a day-time interval, which unlike `timestampdiff` never touches the session zone."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 60.0


def weekday(when: Column) -> Column:
    """Monday is 0."""
    return F.weekday(F.to_date(when))


def calendar_parts(when: Column) -> list[Column]:
    return [
        F.to_date(when).alias("day"),
        F.hour(when).alias("hour"),
        weekday(when).alias("dow"),
    ]


def bucket_key(when: Column, mode: Column) -> Column:
    """Only readings of one bucket are ever compared: `h14`, or `d2h14` by hour of week."""
    hour = F.concat(F.lit("h"), F.hour(when).cast("string"))
    by_week = F.concat(F.lit("d"), weekday(when).cast("string"), hour)
    return F.when(mode == "hour_of_week", by_week).otherwise(hour)


def end_of_hour(when: Column) -> Column:
    """Last second of the hour; the reading time of an hourly usage log."""
    return F.to_date(when).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.hour(when), F.lit(59), F.lit(59)
    )


def end_of_day(when: Column) -> Column:
    return F.to_date(when).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(23), F.lit(59), F.lit(59)
    )


def drop_fraction(when: Column) -> Column:
    """Truncate to whole seconds without leaving NTZ (`date_trunc` would return TIMESTAMP)."""
    return F.to_date(when).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.hour(when), F.minute(when), F.second(when)
    )


def local_clock(utc: Column, zone: str | None) -> Column:
    """UTC to the naive local time of an IANA zone, whole seconds. An unknown zone means UTC."""
    try:
        known = ZoneInfo(zone).key if zone and zone.upper() != "UTC" else "UTC"
    except (ZoneInfoNotFoundError, ValueError):
        known = "UTC"
    moved = utc if known == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(known), utc)
    return drop_fraction(moved)


def chunk_of(when: Column, unit: str) -> Column:
    """Calendar chunk (`day`, `month` or `year`) used to split long histories of one key."""
    day = F.to_date(when)
    return day if unit == "day" else F.trunc(day, unit)
