"""Time columns. All arithmetic is on naive (zone-free) timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
UNKNOWN_PERIOD = "Unknown"


def parse_stamp(text: Column) -> Column:
    """First 19 characters of an ISO stamp, offset ignored; NULL when unreadable."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit(STAMP_FORMAT)).cast("timestamp_ntz")


def naive(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def _second_of_day(moment: Column) -> Column:
    return F.hour(moment) * 3600 + F.minute(moment) * 60 + F.floor(F.second(moment))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, independent of the session zone."""
    days = F.datediff(end.cast("date"), start.cast("date")).cast("bigint")
    return days * 86400 + _second_of_day(end) - _second_of_day(start)


def age_days(created: Column, as_of: datetime, missing: int | None = 0) -> Column:
    """Completed 24-hour days since ``created``."""
    days = F.floor(seconds_between(created, naive(as_of)) / 86400)
    return days if missing is None else F.coalesce(days, F.lit(missing).cast("bigint"))


def resolution_hours(created: Column, resolved: Column) -> Column:
    """Hours from creation to resolution; may be negative; NULL if either is unknown."""
    return seconds_between(created, resolved) / 3600


def week_key(moment: Column) -> Column:
    """``yyyy-Wnn`` with Sunday-first weeks 00-53."""
    day = moment.cast("date")
    week = F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7)
    known = F.format_string("%04d-W%02d", F.year(day), week)
    return F.when(moment.isNull(), UNKNOWN_PERIOD).otherwise(known)


def month_key(moment: Column) -> Column:
    return F.coalesce(F.date_format(moment, "yyyy-MM"), F.lit(UNKNOWN_PERIOD))


def day_key(moment: Column) -> Column:
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd"), F.lit(UNKNOWN_PERIOD))


def micros(stamp: Column, kind: T.DataType) -> Column:
    """Microseconds by which stamps can be ordered; those of a wall clock do not depend on the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(stamp.cast("date")) * 86400 + F.hour(stamp) * 3600 + F.minute(stamp) * 60
        return seconds.cast("bigint") * 1_000_000 + (F.date_part(F.lit("SECOND"), stamp) * 1_000_000).cast("bigint")
    return F.unix_micros(stamp.cast("timestamp"))
