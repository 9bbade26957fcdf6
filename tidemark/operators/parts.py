"""Counts that add up: per event day and part, for summaries that are rolled up from them.

A day's events come in two parts: those of the day's own files, and late ones that other
days' files bring. Each part is counted by user, by repository and hour, by organisation
and hour, by type and hour, and by issue and pull request. Counts of the two parts add up
to those of the day, so a late file changes its own part and leaves the other as stored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.activity import ISSUE, OPENED, PULL_REQUEST, PUSH, STAR, is_action, is_type, repo_part
from tidemark.functions.time import hour_of_day, hour_start
from tidemark.operators.cleaning import scoped
from tidemark.operators.counting import PR_STEPS, overview
from tidemark.operators.ranking import most_pushed, most_starred, top_orgs, top_real_users, top_repos
from tidemark.operators.trends import trend_from
from tidemark.params import DateLike

OWN, LATE = "own", "late"

#: What is counted: the key, whether by hour, and which rows.
KINDS = ("users", "repos", "orgs", "types", "issues", "prs")
NUMBERS = ("n", "n_public", "n_private", "n_stars", "n_pushes", *PR_STEPS)


def _numbers() -> dict[str, Column]:
    steps = {name: F.count_if(is_type(PULL_REQUEST) & (F.col("action") == step)) for name, step in PR_STEPS.items()}
    return {
        "n": F.count(F.lit(1)),
        "n_public": F.count_if(F.col("public")),
        "n_private": F.count_if(~F.col("public")),
        "n_stars": F.count_if(is_type(STAR)),
        "n_pushes": F.count_if(is_type(PUSH)),
        **steps,
    }


#: Kind: key, numbers counted, by hour or not.
COUNTED = {
    "users": ("username", ("n",), False),
    "repos": ("repo", ("n", "n_public", "n_private", "n_stars", "n_pushes"), True),
    "orgs": ("org_name", ("n",), True),
    "types": ("type", ("n",), True),
    "issues": ("issue_id", ("n",), False),
    "prs": ("pr_id", ("n", *PR_STEPS), False),
}


def _wanted(kind: str) -> Column:
    if kind == "orgs":
        return F.col("org_name").isNotNull()
    if kind == "issues":
        return is_action(ISSUE, OPENED) & F.col("issue_id").isNotNull()
    if kind == "prs":
        return is_type(PULL_REQUEST) & F.col("action").isin(*PR_STEPS.values()) & F.col("pr_id").isNotNull()
    return F.lit(True)


def count_parts(events: DataFrame, part: str = "delivered") -> DataFrame:
    """Counts of events by day, part, kind, key and hour; ``part`` says which of the two an event is in.

    One row has the numbers that its kind counts; the others are null.
    """
    numbers = _numbers()

    def of(kind: str) -> DataFrame:
        key, counted, by_hour = COUNTED[kind]
        hour = [hour_start().alias("hour")] if by_hour else []
        rows = scoped(events, None).where(_wanted(kind))
        found = rows.groupBy("event_date", part, F.col(key).cast("string").alias("key"), *hour)
        return found.agg(*[numbers[name].alias(name) for name in counted]).withColumn("kind", F.lit(kind))

    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(of, KINDS))


def _kind(parts: DataFrame, kind: str, *keys: Column) -> DataFrame:
    """The counts of one kind, both parts together."""
    rows = parts.where((F.col("kind") == kind) & (F.col("n") > 0))
    return rows.groupBy("event_date", *keys).agg(*[F.sum(name).alias(name) for name in COUNTED[kind][1]])


def roll_up(parts: DataFrame, date: DateLike | None = None) -> dict[str, DataFrame]:
    """The nine summaries from counts of parts, unsaved; pivots are tidy.

    ``parts`` has ``event_date`` and the columns of ``count_parts``; rows that count
    nothing are passed over. With a ``date`` its overview is there even without events.
    """
    key, hour = F.col("key"), F.col("hour")
    users = _kind(parts, "users", key.alias("username"))
    repos = _kind(parts, "repos", key.alias("repo"))
    orgs = _kind(parts, "orgs", key.alias("org_name"))
    types = _kind(parts, "types", hour_of_day("hour").alias("hour"), key.alias("type"))
    types = types.withColumnRenamed("n", "no_of_events")
    issues = _kind(parts, "issues", key.alias("issue_id"))
    prs = _kind(parts, "prs", key.alias("pr_id"))
    prs = prs.select("event_date", "pr_id", *[(F.col(step) > 0).alias(step) for step in PR_STEPS])
    named = repos.withColumn("repo_name", repo_part("repo", 1))
    repo_hours = _kind(parts, "repos", hour, repo_part("key", 1).alias("repo_name"))
    org_hours = _kind(parts, "orgs", hour, key.alias("org_name"))
    total = F.sum("no_of_events").alias("no_of_events")
    return {
        "event_hour_distribution": types,
        "total_events_per_hour": types.groupBy("event_date", "hour").agg(total),
        "total_diff_events": types.groupBy("event_date", "type").agg(total),
        "top_10_real_users": top_real_users(users, weight="n"),
        "top_3_repo_trend": trend_from(repo_hours, top_repos(named, 3, weight="n"), "repo_name"),
        "top_3_org_trend": trend_from(org_hours, top_orgs(orgs, 5, weight="n"), "org_name"),
        "most_starred_repos": most_starred(repos, weight="n_stars"),
        "top_3_repos_by_pushes": most_pushed(named, weight="n_pushes"),
        "overview_table": overview(parts, date, users=users, repos=repos, orgs=orgs, issues=issues, prs=prs),
    }
