"""Calendar expressions.

The event table stores ``created_at`` as a UTC wall clock (``timestamp_ntz``).
Date and hour taken from it are the same under any session time zone, and they
always agree with the day partition the row lies in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_wall_clock(instant: Column | str) -> Column:
    """The UTC wall clock of an instant, whatever the session time zone is."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(_col(instant)), epoch)


def event_day(ts: Column | str = "created_at") -> Column:
    return F.to_date(_col(ts))


def hour_of_day(ts: Column | str = "created_at") -> Column:
    return F.hour(_col(ts))


def hour_start(ts: Column | str = "created_at") -> Column:
    """The full hour a wall clock lies in.

    ``date_trunc`` would pass a wall clock through the session time zone, and
    that moves hours which a daylight-saving change skips.
    """
    return absolute_hour(event_day(ts), hour_of_day(ts))


def absolute_hour(day: Column | str, hour: Column | str) -> Column:
    """A day plus a number of hours."""
    return _col(day).cast("timestamp_ntz") + F.make_dt_interval(hours=_col(hour))
