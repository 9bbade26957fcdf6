"""Column expressions."""

from tidemark.functions.activity import (
    is_action,
    is_human,
    is_type,
    rate_band,
    ratio_reading,
    repo_part,
    safe_pct,
)
from tidemark.functions.time import absolute_hour, event_day, hour_of_day, hour_start, utc_wall_clock

__all__ = [
    "absolute_hour",
    "event_day",
    "hour_of_day",
    "hour_start",
    "is_action",
    "is_human",
    "is_type",
    "rate_band",
    "ratio_reading",
    "repo_part",
    "safe_pct",
    "utc_wall_clock",
]
