"""Dashboard answers, computed from the stored summaries.

Each takes a summary ``t`` and a date; without a date the answer is given for
every day in ``t``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.activity import rate_band, ratio_reading
from tidemark.functions.time import absolute_hour
from tidemark.operators.cleaning import day_of, quoted, require_columns
from tidemark.operators.counting import avg_events_per_user
from tidemark.operators.ranking import first_per_day
from tidemark.operators.trends import fill_zero, widen
from tidemark.params import DateLike, parse_date

# Marks of the first three places; later places read "#n".
MEDALS = ("🥇", "🥈", "🥉")

# Labels of the two breakdowns.
CONTRIBUTIONS = {
    "issues_opened": "Issues Opened",
    "prs_created": "PRs Created",
    "prs_merged": "PRs Merged",
    "prs_closed": "PRs Closed",
}
REPO_KINDS = {
    "total_public_repo": "Public Repos",
    "total_private_repo": "Private Repos",
}


def _for_day(t: DataFrame, date: DateLike | None) -> DataFrame:
    return t if date is None else t.where(F.col("event_date") == day_of(date))


def _cards(t: DataFrame, date: DateLike | None, k: int, n_col: str, name: str) -> DataFrame:
    return first_per_day(_for_day(t, date), k, n_col, name, place="position")


def day_trend(t: DataFrame, date: DateLike | None = None) -> DataFrame:
    """Events per hour in time order, with each hour as a point in time."""
    require_columns(t, ["event_date", "hour", "no_of_events"])
    return (
        _for_day(t, date)
        .select("event_date", absolute_hour("event_date", "hour").alias("hour"), "no_of_events")
        .orderBy("hour")
    )


def peak_hours(t: DataFrame, date: DateLike | None = None, k: int = 3) -> DataFrame:
    """The busiest hours of a day, numbered and labelled."""
    return _cards(t, date, k, "no_of_events", "hour").select(
        "event_date", "position", F.format_string("%d:00", F.col("hour")).alias("label"), "no_of_events"
    )


def trend_filled(
    t: DataFrame,
    names: Sequence[str],
    date: DateLike | None = None,
    key: str = "repo_name",
    asked: DataFrame | None = None,
) -> DataFrame:
    """A stored tidy trend as one column per name, 0 where a name had no event.

    Every hour of the stored trend stays, also one in which only other names
    were active. Over many days the names asked for may differ by day: then
    ``asked`` holds them as (event_date, name), and a name counts only on its
    days.
    """
    shown = _for_day(t, date)
    if asked is not None:
        marks = asked.select("event_date", key, F.lit(True).alias("_asked"))
        joined = shown.join(marks, ["event_date", key], "left")
        shown = joined.withColumn(key, F.when(F.col("_asked"), F.col(key)))
    return fill_zero(widen(shown, key, "no_of_events", names), names)


def starred_cards(t: DataFrame, date: DateLike | None = None, k: int = 3) -> DataFrame:
    """The most starred repositories with their position."""
    cards = _cards(t, date, k, "no_of_watchers", "repo")
    return cards.select("event_date", "position", "repo_name", "no_of_watchers")


def pushed_cards(t: DataFrame, date: DateLike | None = None, k: int = 3) -> DataFrame:
    """The most pushed repositories with their position."""
    cards = _cards(t, date, k, "no_of_pushes", "repo_name")
    return cards.select("event_date", "position", "repo_name", "no_of_pushes")


def top_users_card(t: DataFrame, date: DateLike | None = None, k: int = 5) -> DataFrame:
    """The leading users, the first three with a medal."""
    require_columns(t, ["username", "no_of_Events_per_user", "event_date", "rank_on_that_day"])
    position = F.col("position")
    mark = F.when(position == 1, MEDALS[0]).when(position == 2, MEDALS[1]).when(position == 3, MEDALS[2])
    return _cards(t, date, k, "no_of_Events_per_user", "username").select(
        "event_date",
        "position",
        F.coalesce(mark, F.format_string("#%d", position)).alias("mark"),
        "username",
        "no_of_Events_per_user",
        "rank_on_that_day",
    )


def kpi_summary(t: DataFrame, date: DateLike | None = None) -> DataFrame:
    """The key figures of a day; rates are percentages, given once."""
    return avg_events_per_user(_for_day(t, date)).select(
        "event_date",
        "no_of_unique_users",
        "total_events",
        "pr_merge_rate",
        "issue_pr_activity_ratio_daily",
        "no_of_unique_repos_modified",
        "no_of_unique_organizations",
        "avg_events_per_user",
        rate_band("pr_merge_rate").alias("pr_merge_band"),
        ratio_reading("issues_opened", "prs_created").alias("issue_pr_reading"),
    )


def answered(answer: DataFrame, dates: Sequence[DateLike]) -> DataFrame:
    """An answer for each of the dates asked, also where there is no data for one.

    ``has_data`` says whether there is; without, the date has one row with nothing else in
    it. Dates that nobody asked for are left out, and a date asked twice is answered once.
    """
    days = sorted({parse_date(d) for d in dates})
    asked = answer.sparkSession.createDataFrame([(d,) for d in days], "event_date date")
    found = answer.where(F.col("event_date").isin(days)).withColumn("has_data", F.lit(True))
    joined = asked.join(found, "event_date", "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))
    return joined.select("event_date", "has_data", *[quoted(c) for c in answer.columns if c not in ("event_date", "has_data")])


def breakdown(
    overview: DataFrame, labels: Mapping[str, str] = CONTRIBUTIONS, date: DateLike | None = None
) -> DataFrame:
    """Overview columns as rows of label and value."""
    columns = [F.col(name).alias(label) for name, label in labels.items()]
    named = _for_day(overview, date).select("event_date", *columns)
    return named.unpivot("event_date", list(labels.values()), "label", "value")
