"""Predicates, labels and ratios about events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.time import _col

# What marks an account as automated. Matching is case-sensitive.
BOT_MARK = "[bot]"
BOT_SUFFIX = "-bot"
BOT_NAME = "Copilot"

# Event types and actions the summaries look at.
PUSH = "PushEvent"
STAR = "WatchEvent"
ISSUE = "IssuesEvent"
PULL_REQUEST = "PullRequestEvent"
OPENED, MERGED, CLOSED = "opened", "merged", "closed"

# A rate in percent is high from 80 on and medium from 50 on.
HIGH_RATE = 80.0
MEDIUM_RATE = 50.0


def is_type(name: str, type_col: Column | str = "type") -> Column:
    return _col(type_col) == name


def is_action(
    type_name: str, action_name: str, action: Column | str = "action", type_col: Column | str = "type"
) -> Column:
    return is_type(type_name, type_col) & (_col(action) == action_name)


def is_human(login: Column | str = "username") -> Column:
    """False for automated accounts, null for a missing login."""
    login = _col(login)
    return ~login.contains(BOT_MARK) & ~login.endswith(BOT_SUFFIX) & (login != BOT_NAME)


def repo_part(repo: Column | str, position: int) -> Column:
    """Owner (0) or name (1) of ``owner/name``; null where the part is missing."""
    return F.get(F.split(_col(repo), "/"), F.lit(position))


def safe_pct(numerator: Column | str, denominator: Column | str) -> Column:
    """Share in percent, rounded to two places; 0 where there is nothing to divide by."""
    num, den = _col(numerator), _col(denominator)
    return F.round(F.when(den != 0, num / den * 100).otherwise(F.lit(0.0)), 2)


def rate_band(rate: Column | str) -> Column:
    """Band of a rate given in percent: high, medium or low."""
    rate = _col(rate)
    return (
        F.when(rate >= HIGH_RATE, "high")
        .when(rate >= MEDIUM_RATE, "medium")
        .when(rate.isNotNull(), "low")
    )


def ratio_reading(
    issues: Column | str, prs: Column | str, tolerance: float = 0.1
) -> Column:
    """What issues opened per pull request created says about a day.

    More issues than pull requests means that work comes in faster than it is
    dealt with. ``tolerance`` is how far from 1 still counts as balanced. A day
    without pull requests has no ratio and reads null.
    """
    issues, prs = _col(issues), _col(prs)
    ratio = F.when(prs != 0, issues / prs)
    return (
        F.when(ratio > 1 + tolerance, "backlog growing")
        .when(ratio < 1 - tolerance, "backlog shrinking")
        .when(ratio.isNotNull(), "balanced")
    )
