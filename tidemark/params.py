"""Arguments of a daily run."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

# The default run date, which is also the first day with data.
FIRST_DAY = dt.date(2015, 1, 1)
HOURS = range(24)

DateLike = str | dt.date


def parse_date(value: DateLike, *, check_range: bool = False) -> dt.date:
    """Turn ``YYYY-MM-DD`` (or a date) into a date.

    ``check_range`` also refuses days before the first one with data and days
    that have not begun yet.
    """
    if isinstance(value, dt.datetime):
        raise ValueError(f"a day is wanted, not a point in time: {value!r}")
    if isinstance(value, str):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            raise ValueError(f"date must look like YYYY-MM-DD: {value!r}")
        value = dt.date.fromisoformat(value)
    today = dt.datetime.now(dt.timezone.utc).date()
    if check_range and not FIRST_DAY <= value <= today:
        raise ValueError(f"date must lie between {FIRST_DAY} and {today}: {value}")
    return value


def hour_window(start: int = 0, duration: int = 24) -> Sequence[int]:
    """Hours of a day covered by a start hour and a number of hours."""
    if start not in HOURS:
        raise ValueError(f"start hour must be 0 to 23: {start}")
    if duration < 1 or start + duration > 24:
        raise ValueError(f"{duration} hours from hour {start} do not fit into one day")
    return range(start, start + duration)
