"""Operators: functions from DataFrame to DataFrame."""

from tidemark.operators.cleaning import (
    dedupe,
    drop_incomplete,
    events_once,
    flatten,
    is_complete,
    late_events,
    on_day,
    require_columns,
    select_columns,
)
from tidemark.operators.counting import (
    activity_metrics,
    avg_events_per_user,
    event_hour_distribution,
    events_by_type_and_time,
    events_per_hour,
    events_per_type,
    flow_metrics,
    hourly_type_counts,
    org_counts,
    overview,
    overview_counts,
    repo_counts,
    top_counted,
    user_counts,
    with_ratios,
)
from tidemark.operators.parts import KINDS, LATE, OWN, count_parts, roll_up
from tidemark.operators.ranking import (
    first_per_day,
    leaders_per_hour,
    most_pushed,
    most_starred,
    rank_by_count,
    top_k,
    top_orgs,
    top_real_users,
    top_repos,
)
from tidemark.operators.serving import (
    CONTRIBUTIONS,
    REPO_KINDS,
    answered,
    breakdown,
    day_trend,
    kpi_summary,
    peak_hours,
    pushed_cards,
    starred_cards,
    top_users_card,
    trend_filled,
)
from tidemark.operators.trends import hourly_counts, keep_top, labels_of_day, trend_from, trend_long, trend_of, trend_wide, widen
from tidemark.operators.variant import payload_members, variant_events, variant_members

__all__ = [
    "CONTRIBUTIONS",
    "KINDS",
    "LATE",
    "OWN",
    "REPO_KINDS",
    "activity_metrics",
    "answered",
    "avg_events_per_user",
    "breakdown",
    "count_parts",
    "day_trend",
    "dedupe",
    "drop_incomplete",
    "event_hour_distribution",
    "events_by_type_and_time",
    "events_once",
    "events_per_hour",
    "events_per_type",
    "first_per_day",
    "flatten",
    "flow_metrics",
    "hourly_counts",
    "hourly_type_counts",
    "is_complete",
    "keep_top",
    "kpi_summary",
    "labels_of_day",
    "late_events",
    "leaders_per_hour",
    "most_pushed",
    "most_starred",
    "on_day",
    "org_counts",
    "overview",
    "overview_counts",
    "payload_members",
    "peak_hours",
    "pushed_cards",
    "rank_by_count",
    "repo_counts",
    "require_columns",
    "roll_up",
    "select_columns",
    "starred_cards",
    "top_counted",
    "top_k",
    "top_orgs",
    "top_real_users",
    "top_repos",
    "top_users_card",
    "trend_filled",
    "trend_from",
    "trend_long",
    "trend_of",
    "trend_wide",
    "user_counts",
    "variant_events",
    "variant_members",
    "widen",
    "with_ratios",
]
