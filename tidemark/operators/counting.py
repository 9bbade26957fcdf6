"""Counts per hour and type, and the daily overview."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.activity import (
    CLOSED,
    ISSUE,
    MERGED,
    OPENED,
    PULL_REQUEST,
    PUSH,
    STAR,
    is_action,
    is_type,
    safe_pct,
)
from tidemark.functions.time import hour_of_day
from tidemark.operators.cleaning import day_of, scoped
from tidemark.operators.ranking import first_per_day
from tidemark.params import DateLike


def _rows() -> Column:
    return F.count(F.lit(1))


def events_by_type_and_time(df: DataFrame, date: DateLike | None = None) -> DataFrame:
    """Events per type and exact time."""
    return scoped(df, date).groupBy("event_date", "type", "created_at").agg(_rows().alias("no_of_events"))


def hourly_type_counts(df: DataFrame, date: DateLike | None = None) -> DataFrame:
    """Events per hour and type, tidy: a few hundred rows per day.

    The other counts per hour or per type are sums of these, so one pass over
    the events serves all of them.
    """
    return (
        scoped(df, date)
        .groupBy("event_date", hour_of_day().alias("hour"), "type")
        .agg(_rows().alias("no_of_events"))
    )


def event_hour_distribution(
    df: DataFrame, date: DateLike | None = None, types: Sequence[str] | None = None
) -> DataFrame:
    """Events per hour with one column per type; a pair without events is null.

    Give ``types`` where they are known: otherwise Spark runs one more job to
    find them.
    """
    counts = hourly_type_counts(df, date)
    pivoted = counts.groupBy("event_date", "hour").pivot("type", list(types) if types is not None else None)
    return pivoted.agg(F.sum("no_of_events"))


def events_per_hour(df: DataFrame, date: DateLike | None = None) -> DataFrame:
    """Events per hour of the day; hours without events are absent."""
    return (
        scoped(df, date).groupBy("event_date", hour_of_day().alias("hour")).agg(_rows().alias("no_of_events"))
    )


def events_per_type(df: DataFrame, date: DateLike | None = None) -> DataFrame:
    """Events per type."""
    return scoped(df, date).groupBy("event_date", "type").agg(_rows().alias("no_of_events"))


# The counts of the overview, by what they count.
ACTIVITY_COUNTS = (
    "no_of_unique_users",
    "no_of_unique_repos_modified",
    "total_public_repo",
    "total_private_repo",
    "no_of_unique_organizations",
    "total_events",
)
FLOW_COUNTS = ("issues_opened", "prs_created", "prs_merged", "prs_closed")
OVERVIEW_COUNTS = (*ACTIVITY_COUNTS, *FLOW_COUNTS)


def user_counts(df: DataFrame, date: DateLike | None = None) -> DataFrame:
    """Events per user and day."""
    return scoped(df, date).groupBy("event_date", "username").agg(_rows().alias("n"))


def repo_counts(df: DataFrame, date: DateLike | None = None) -> DataFrame:
    """Events, public and private events, stars and pushes per repository and day."""
    return (
        scoped(df, date)
        .groupBy("event_date", "repo")
        .agg(
            _rows().alias("n"),
            F.count_if(F.col("public")).alias("n_public"),
            F.count_if(~F.col("public")).alias("n_private"),
            F.count_if(is_type(STAR)).alias("n_stars"),
            F.count_if(is_type(PUSH)).alias("n_pushes"),
        )
    )


def org_counts(df: DataFrame, date: DateLike | None = None) -> DataFrame:
    """Events per organisation and day; events without one are left out."""
    return scoped(df, date).where(F.col("org_name").isNotNull()).groupBy("event_date", "org_name").agg(_rows().alias("n"))


def _opened_issues(df: DataFrame, date: DateLike | None, issue: str, action: str) -> DataFrame:
    opened = scoped(df, date).where(is_action(ISSUE, OPENED, action) & F.col(issue).isNotNull())
    return opened.select("event_date", F.col(issue).alias("issue_id")).distinct()


PR_STEPS = {"prs_created": OPENED, "prs_merged": MERGED, "prs_closed": CLOSED}


def _pull_requests(df: DataFrame, date: DateLike | None, pr: str, action: str) -> DataFrame:
    moved = scoped(df, date).where(
        is_type(PULL_REQUEST) & F.col(action).isin(*PR_STEPS.values()) & F.col(pr).isNotNull()
    )
    return moved.groupBy("event_date", F.col(pr).alias("pr_id")).agg(
        *[F.bool_or(F.col(action) == step).alias(name) for name, step in PR_STEPS.items()]
    )


def overview_counts(
    df: DataFrame,
    date: DateLike | None = None,
    users: DataFrame | None = None,
    repos: DataFrame | None = None,
    orgs: DataFrame | None = None,
    issues: DataFrame | None = None,
    prs: DataFrame | None = None,
    wanted: Sequence[str] = OVERVIEW_COUNTS,
    issue: str = "issue_id",
    pr: str = "pr_id",
    action: str = "action",
) -> DataFrame:
    """The overview counts per day, or those of them that are wanted.

    Nine distinct counts in one aggregate would copy every event ten times and
    group the copies by a key as wide as all columns together. Here each kind
    of thing (user, repository, organisation, issue, pull request) is grouped
    on its own narrow key, from the few columns it needs, and then counted per
    day; the counts per day are put together at the end. A popular repository
    shrinks to one row per task before the shuffle. Kinds that nobody wants are
    not read; a plain count per day keeps the days that have events of other
    kinds only. The counts per user, repository and organisation, the issues opened
    and the pull requests with their steps may be handed in where they are there already. The last arguments are column paths, so
    raw nested events can be counted as they are.
    """
    kinds = {
        "users": (
            lambda: user_counts(df, date) if users is None else users,
            {"no_of_unique_users": F.count("username"), "total_events": F.sum("n")},
        ),
        "repos": (
            lambda: (repo_counts(df, date) if repos is None else repos).where(F.col("repo").isNotNull()),
            {
                "no_of_unique_repos_modified": _rows(),
                "total_public_repo": F.count_if(F.col("n_public") > 0),
                "total_private_repo": F.count_if(F.col("n_private") > 0),
            },
        ),
        "orgs": (lambda: org_counts(df, date) if orgs is None else orgs, {"no_of_unique_organizations": _rows()}),
        "issues": (lambda: _opened_issues(df, date, issue, action) if issues is None else issues, {"issues_opened": _rows()}),
        "prs": (lambda: _pull_requests(df, date, pr, action) if prs is None else prs, {name: F.count_if(F.col(name)) for name in PR_STEPS}),
    }
    chosen = {name: kind for name, kind in kinds.items() if set(kind[1]) & set(wanted) - {"total_events"}}
    if "users" not in chosen:
        chosen["days"] = (lambda: scoped(df, date), {"total_events": _rows()})
    per_day = [
        make().groupBy("event_date").agg(*[count.alias(name) for name, count in counts.items()])
        for make, counts in chosen.values()
    ]
    together = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), per_day)
    columns = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in wanted]
    if date is None:
        return together.groupBy("event_date").agg(*columns)
    # One row even for a day without events.
    return together.agg(*columns).select(day_of(date).alias("event_date"), *wanted)


def activity_metrics(df: DataFrame, date: DateLike | None = None) -> DataFrame:
    """Users, repositories, organisations and events per day; nulls do not count."""
    return overview_counts(df, date, wanted=ACTIVITY_COUNTS)


def flow_metrics(
    df: DataFrame,
    date: DateLike | None = None,
    issue: str = "issue_id",
    pr: str = "pr_id",
    action: str = "action",
) -> DataFrame:
    """Issues and pull requests per day, also of raw nested events by the paths of their members."""
    return overview_counts(df, date, wanted=FLOW_COUNTS, issue=issue, pr=pr, action=action)


# The percentages of an overview, as (of, per).
RATES = {
    "issue_pr_activity_ratio_daily": ("issues_opened", "prs_created"),
    "pr_merge_rate": ("prs_closed", "prs_created"),
    "pr_merged_rate": ("prs_merged", "prs_created"),
}


def with_ratios(df: DataFrame) -> DataFrame:
    """Add the percentages of an overview, those whose counts it has.

    ``pr_merge_rate`` is closed per created, the value published under that
    name; ``pr_merged_rate`` is what the name says.
    """
    return df.withColumns({name: safe_pct(*pair) for name, pair in RATES.items() if set(pair) <= set(df.columns)})


def overview(df: DataFrame, date: DateLike | None = None, **counted: DataFrame) -> DataFrame:
    """The daily overview: counts and percentages, one row per day."""
    return with_ratios(overview_counts(df, date, **counted))


def avg_events_per_user(df: DataFrame) -> DataFrame:
    """Add events per user to an overview; 0 for a day without users."""
    users, events = F.col("no_of_unique_users"), F.col("total_events")
    average = F.round(F.when(users > 0, events / users).otherwise(F.lit(0.0)), 2)
    return df.withColumn("avg_events_per_user", average)


def top_counted(df: DataFrame, col: str, k: int = 3, date: DateLike | None = None) -> DataFrame:
    """The values of a column with most rows per day; a missing value counts 0."""
    counts = scoped(df, date).groupBy("event_date", col).agg(F.count(col).alias("no_of_events"))
    return first_per_day(counts, k, "no_of_events", col)
