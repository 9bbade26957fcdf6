"""The same queries as SQL over the given tables, for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Sequence

from tidemark.fixtures import ORG_NAMES, REPO_NAMES

ONE_DAY = "DATE '2024-01-15'"

EVENTS = """
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
    CASE event_type WHEN 'click' THEN 'PushEvent' WHEN 'view' THEN 'WatchEvent'
      WHEN 'signup' THEN 'IssuesEvent' WHEN 'purchase' THEN 'PullRequestEvent'
      ELSE 'IssueCommentEvent' END AS type,
    ts AS created_at, event_id % 10 <> 0 AS public, user_id,
    CASE WHEN user_id % 10 = 0 THEN concat('user', user_id, '[bot]')
      WHEN user_id % 10 = 1 THEN concat('user', user_id, '-bot')
      WHEN user_id = 2 THEN 'Copilot' ELSE concat('user', user_id) END AS username,
    k AS repo_id, concat('owner', k % 7, '/repo', k % 20) AS repo,
    concat('owner', k % 7) AS repo_owner, concat('repo', k % 20) AS repo_name,
    CASE WHEN k % 3 <> 0 THEN k % 9 END AS org_id,
    CASE WHEN k % 3 <> 0 THEN concat('org', k % 9) END AS org_name,
    CASE event_type
      WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'opened' ELSE 'closed' END
      WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'opened' WHEN 1 THEN 'merged' ELSE 'closed' END
      WHEN 'error' THEN 'created' END AS action,
    CASE WHEN event_type = 'purchase' THEN event_id // 10 END AS pr_id,
    CASE WHEN event_type = 'signup' THEN event_id // 10 END AS issue_id,
    CASE WHEN event_type = 'error' THEN event_id END AS comment_id,
    CAST(ts AS DATE) AS event_date
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e)
"""

# Raw events: every 50th twice, the copy a second later; every 97th without a login.
RAW = """
raw AS (
  SELECT * REPLACE (created_at + copy * INTERVAL 1 SECOND AS created_at,
      CASE WHEN CAST(event_id AS BIGINT) % 97 <> 0 THEN username END AS username),
    username AS name_before_damage
  FROM ev, (VALUES (0), (1)) c(copy)
  WHERE copy = 0 OR CAST(event_id AS BIGINT) % 50 = 0),
kept AS (
  SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY created_at) = 1)
"""

# The event table as built from the raw events.
SILVER = """
silver AS (
  SELECT event_id, type, created_at, public, user_id, username,
    concat('users/', name_before_damage) AS actor_url,
    repo_id, repo, repo_owner, repo_name, concat('repos/', repo) AS repo_url,
    org_id, org_name, action, pr_id, issue_id, comment_id,
    CASE WHEN comment_id IS NOT NULL
      THEN concat('line one', chr(10), '"quoted" ', comment_id) END AS comment_body,
    CASE WHEN comment_id IS NOT NULL THEN name_before_damage END AS comment_user,
    CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month,
    CAST(day(created_at) AS INTEGER) AS day
  FROM kept
  WHERE event_id IS NOT NULL AND type IS NOT NULL AND username IS NOT NULL AND repo IS NOT NULL)
"""

ACTIVITY = """
    count(DISTINCT username) AS no_of_unique_users,
    count(DISTINCT repo) AS no_of_unique_repos_modified,
    count(DISTINCT CASE WHEN public THEN repo END) AS total_public_repo,
    count(DISTINCT CASE WHEN NOT public THEN repo END) AS total_private_repo,
    count(DISTINCT org_name) AS no_of_unique_organizations,
    count(*) AS total_events
"""

FLOW = """
    count(DISTINCT CASE WHEN type = 'IssuesEvent' AND action = 'opened' THEN issue_id END) AS issues_opened,
    count(DISTINCT CASE WHEN type = 'PullRequestEvent' AND action = 'opened' THEN pr_id END) AS prs_created,
    count(DISTINCT CASE WHEN type = 'PullRequestEvent' AND action = 'merged' THEN pr_id END) AS prs_merged,
    count(DISTINCT CASE WHEN type = 'PullRequestEvent' AND action = 'closed' THEN pr_id END) AS prs_closed
"""


def _overview(source: str) -> str:
    return f"""
overview AS (
  SELECT *,
    CASE WHEN prs_created <> 0 THEN round(issues_opened / prs_created * 100, 2) ELSE 0.0 END
      AS issue_pr_activity_ratio_daily,
    CASE WHEN prs_created <> 0 THEN round(prs_closed / prs_created * 100, 2) ELSE 0.0 END AS pr_merge_rate,
    CASE WHEN prs_created <> 0 THEN round(prs_merged / prs_created * 100, 2) ELSE 0.0 END AS pr_merged_rate
  FROM (SELECT CAST(created_at AS DATE) AS event_date, {ACTIVITY}, {FLOW} FROM {source} GROUP BY 1))
"""


OVERVIEW = _overview("ev")
WITH_PARTS = """
SELECT *, CAST(year(event_date) AS INTEGER) AS year, CAST(month(event_date) AS INTEGER) AS month,
  CAST(day(event_date) AS INTEGER) AS day
FROM overview
"""

PER_HOUR = """
per_hour AS (
  SELECT event_date, CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS no_of_events
  FROM ev GROUP BY ALL)
"""


def _top(key: str, k: int, n_col: str, where: str = "true", counted: str = "*") -> str:
    return f"""
top AS (
  SELECT event_date, {key}, count({counted}) AS {n_col} FROM ev WHERE {where} GROUP BY event_date, {key}
  QUALIFY row_number() OVER (
    PARTITION BY event_date ORDER BY count({counted}) DESC, {key} NULLS LAST) <= {k})
"""


HUMAN = "NOT contains(username, '[bot]') AND NOT ends_with(username, '-bot') AND username <> 'Copilot'"
TOP_USERS = _top("username", 10, "no_of_Events_per_user", HUMAN)
STARRED = _top("repo", 5, "no_of_watchers", "type = 'WatchEvent'")
PUSHED = _top("repo_name", 3, "no_of_pushes", "type = 'PushEvent'")


def _trend(key: str, k: int) -> str:
    return (
        _top(key, k, "total", f"{key} IS NOT NULL")
        + f""",
trend AS (
  SELECT event_date, date_trunc('hour', created_at) AS hour, {key}, count(*) AS no_of_events
  FROM ev SEMI JOIN top USING (event_date, {key}) GROUP BY ALL)
"""
    )


def _pivot(key: str, labels: Sequence[str]) -> str:
    cells = ", ".join(f"CAST(sum(no_of_events) FILTER ({key} = '{name}') AS BIGINT) AS {name}" for name in labels)
    return f"SELECT event_date, hour, {cells} FROM trend GROUP BY event_date, hour"


def _filled(key: str, k: int, labels: Sequence[str]) -> str:
    cells = ", ".join(
        f"CAST(coalesce(sum(no_of_events) FILTER (wanted = '{name}'), 0) AS BIGINT) AS {name}" for name in labels
    )
    return f"""WITH {EVENTS}, {_trend(key, k)},
asked AS (
  SELECT event_date, {key}, {key} AS wanted FROM ev WHERE {key} IS NOT NULL GROUP BY event_date, {key}
  QUALIFY row_number() OVER (PARTITION BY event_date ORDER BY count({key}) DESC, {key}) <= 3)
SELECT event_date, hour, {cells} FROM trend LEFT JOIN asked USING (event_date, {key}) GROUP BY event_date, hour"""


def _adhoc(key: str) -> str:
    return f"""WITH {EVENTS}
SELECT {key}, count({key}) AS no_of_events FROM ev WHERE event_date = {ONE_DAY}
GROUP BY {key} ORDER BY no_of_events DESC, {key} LIMIT 3"""


def _cards(n_col: str, name: str, k: int) -> str:
    return f"""
cards AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY event_date ORDER BY {n_col} DESC, {name}) AS INTEGER) AS position
  FROM top QUALIFY position <= {k})
"""


def _unpivot(labels: dict[str, str]) -> str:
    parts = [f"SELECT event_date, '{label}' AS label, {name} AS value FROM overview" for name, label in labels.items()]
    return f"WITH {EVENTS}, {OVERVIEW} " + " UNION ALL ".join(parts)


def _band(rate: str) -> str:
    return f"CASE WHEN {rate} >= 80 THEN 'high' WHEN {rate} >= 50 THEN 'medium' ELSE 'low' END"


READING = """CASE WHEN prs_created = 0 THEN NULL
  WHEN issues_opened / prs_created > 1.1 THEN 'backlog growing'
  WHEN issues_opened / prs_created < 0.9 THEN 'backlog shrinking'
  ELSE 'balanced' END"""

TYPES = ["IssueCommentEvent", "IssuesEvent", "PullRequestEvent", "PushEvent", "WatchEvent"]

ORACLE: dict[str, str] = {
    "bronze_scan": f"""WITH {EVENTS}, {RAW}
SELECT type, count(*) AS n, count(username) AS with_login, count(comment_id) AS with_comment,
  count(*) AS with_source FROM raw GROUP BY type""",
    "bronze_hours": f"""WITH {EVENTS}, {RAW}
SELECT event_id, type, concat('2024-01-15-', hour(created_at), '.json.gz') AS file FROM raw
WHERE CAST(created_at AS DATE) = {ONE_DAY} AND hour(created_at) BETWEEN 6 AND 11""",
    "bronze_inferred": f"WITH {EVENTS}, {RAW} SELECT event_id, type, repo, action FROM raw",
    "silver_flatten": f"WITH {EVENTS}, {RAW}, {SILVER} SELECT * FROM silver",
    "dedupe_events": f"""WITH {EVENTS}, {RAW}
SELECT event_id, type, created_at FROM kept""",
    "null_checked_events": f"""WITH {EVENTS}, {RAW}
SELECT event_id, type, username FROM kept
WHERE event_id IS NOT NULL AND type IS NOT NULL AND username IS NOT NULL AND repo IS NOT NULL""",
    "silver_day": f"WITH {EVENTS} SELECT * FROM ev WHERE CAST(created_at AS DATE) = {ONE_DAY}",
    "human_events": f"WITH {EVENTS} SELECT event_id, username FROM ev WHERE {HUMAN}",
    "events_by_type_and_time": f"""WITH {EVENTS}
SELECT event_date, type, created_at, count(*) AS no_of_events FROM ev GROUP BY ALL""",
    "event_hour_distribution": f"""WITH {EVENTS}
SELECT event_date, CAST(hour(created_at) AS INTEGER) AS hour, """
    + ", ".join(f"nullif(count(*) FILTER (type = '{t}'), 0) AS {t}" for t in TYPES)
    + " FROM ev GROUP BY ALL",
    "event_hour_distribution_long": f"""WITH {EVENTS}
SELECT event_date, CAST(hour(created_at) AS INTEGER) AS hour, type, count(*) AS no_of_events
FROM ev GROUP BY ALL""",
    "total_events_per_hour": f"WITH {EVENTS}, {PER_HOUR} SELECT * FROM per_hour",
    "total_diff_events": f"WITH {EVENTS} SELECT event_date, type, count(*) AS no_of_events FROM ev GROUP BY ALL",
    "activity_metrics": f"WITH {EVENTS} SELECT event_date, {ACTIVITY} FROM ev GROUP BY event_date",
    "flow_metrics": f"WITH {EVENTS} SELECT event_date, {FLOW} FROM ev GROUP BY event_date",
    "flow_metrics_nested": f"WITH {EVENTS} SELECT event_date, {FLOW} FROM ev GROUP BY event_date",
    "overview_table": f"WITH {EVENTS}, {OVERVIEW} SELECT * FROM overview",
    "top_10_real_users": f"""WITH {EVENTS}, {TOP_USERS}
SELECT *, CAST(dense_rank() OVER (
  PARTITION BY event_date ORDER BY no_of_Events_per_user DESC) AS INTEGER) AS rank_on_that_day
FROM top""",
    "top_repo_per_hour": f"""WITH {EVENTS}
SELECT date_trunc('hour', created_at) AS hour, repo_name, count(*) AS no_of_events
FROM ev GROUP BY 1, 2
QUALIFY dense_rank() OVER (PARTITION BY date_trunc('hour', created_at) ORDER BY count(*) DESC) = 1""",
    "top_repos": f"WITH {EVENTS}, {_top('repo_name', 3, 'no_of_events')} SELECT * FROM top",
    "top_repos_with_owner": f"WITH {EVENTS}, {_top('repo', 3, 'no_of_events')} SELECT * FROM top",
    "top_orgs": f"WITH {EVENTS}, {_top('org_name', 5, 'no_of_events', 'org_name IS NOT NULL')} SELECT * FROM top",
    "most_starred_repos": f"""WITH {EVENTS}, {STARRED}
SELECT event_date, repo, nullif(split_part(repo, '/', 1), '') AS repo_owner,
  nullif(split_part(repo, '/', 2), '') AS repo_name, no_of_watchers FROM top""",
    "top_3_repos_by_pushes": f"WITH {EVENTS}, {PUSHED} SELECT * FROM top",
    "top_counted_repos": f"""WITH {EVENTS},
{_top('repo_name', 3, 'no_of_events', counted='repo_name')} SELECT * FROM top""",
    "top_counted_orgs": f"""WITH {EVENTS},
{_top('org_name', 3, 'no_of_events', counted='org_name')} SELECT * FROM top""",
    "adhoc_top_repos": _adhoc("repo_name"),
    "adhoc_top_orgs": _adhoc("org_name"),
    "top_repo_trend_long": f"WITH {EVENTS}, {_trend('repo_name', 3)} SELECT * FROM trend",
    "top_org_trend_long": f"WITH {EVENTS}, {_trend('org_name', 5)} SELECT * FROM trend",
    "events_of_top_repos": f"""WITH {EVENTS}, {_top('repo_name', 3, 'total')}
SELECT event_date, event_id, repo_name, type FROM ev SEMI JOIN top USING (event_date, repo_name)""",
    "top_3_repo_trend": f"WITH {EVENTS}, {_trend('repo_name', 3)} {_pivot('repo_name', REPO_NAMES)}",
    "top_3_org_trend": f"WITH {EVENTS}, {_trend('org_name', 5)} {_pivot('org_name', ORG_NAMES)}",
    "repo_trend_filled": _filled("repo_name", 3, REPO_NAMES),
    "org_trend_filled": _filled("org_name", 5, ORG_NAMES),
    "day_trend": f"""WITH {EVENTS}, {PER_HOUR}
SELECT event_date, event_date + hour * INTERVAL 1 HOUR AS hour, no_of_events FROM per_hour""",
    "peak_hours": f"""WITH {EVENTS}, {PER_HOUR}
SELECT event_date,
  CAST(row_number() OVER (PARTITION BY event_date ORDER BY no_of_events DESC, hour) AS INTEGER) AS position,
  concat(hour, ':00') AS label, no_of_events
FROM per_hour QUALIFY position <= 3""",
    "starred_cards": f"""WITH {EVENTS}, {STARRED}, {_cards('no_of_watchers', 'repo', 3)}
SELECT event_date, position, split_part(repo, '/', 2) AS repo_name, no_of_watchers FROM cards""",
    "pushed_cards": f"""WITH {EVENTS}, {PUSHED}, {_cards('no_of_pushes', 'repo_name', 3)}
SELECT event_date, position, repo_name, no_of_pushes FROM cards""",
    "top_users_card": f"""WITH {EVENTS}, {TOP_USERS}, {_cards('no_of_Events_per_user', 'username', 5)}
SELECT event_date, position,
  CASE position WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE concat('#', position) END AS mark,
  username, no_of_Events_per_user,
  CAST(dense_rank() OVER (PARTITION BY event_date ORDER BY no_of_Events_per_user DESC) AS INTEGER)
    AS rank_on_that_day
FROM cards""",
    "kpi_summary": f"""WITH {EVENTS}, {OVERVIEW}
SELECT event_date, no_of_unique_users, total_events, pr_merge_rate, issue_pr_activity_ratio_daily,
  no_of_unique_repos_modified, no_of_unique_organizations,
  CASE WHEN no_of_unique_users > 0 THEN round(total_events / no_of_unique_users, 2) ELSE 0.0 END
    AS avg_events_per_user,
  {_band('pr_merge_rate')} AS pr_merge_band, {READING} AS issue_pr_reading
FROM overview""",
    "contribution_breakdown": _unpivot(
        {
            "issues_opened": "Issues Opened",
            "prs_created": "PRs Created",
            "prs_merged": "PRs Merged",
            "prs_closed": "PRs Closed",
        }
    ),
    "repo_distribution": _unpivot({"total_public_repo": "Public Repos", "total_private_repo": "Private Repos"}),
    "rate_band": f"""WITH {EVENTS}, {OVERVIEW}
SELECT event_date, {_band('pr_merge_rate')} AS merge_band, {_band('pr_merged_rate')} AS merged_band
FROM overview""",
    "ratio_reading": f"WITH {EVENTS}, {OVERVIEW} SELECT event_date, {READING} AS reading FROM overview",
    "gold_roundtrip": f"WITH {EVENTS}, {OVERVIEW} {WITH_PARTS}",
    "stored_wide_trend": f"WITH {EVENTS}, {_trend('org_name', 5)} {_pivot('org_name', ORG_NAMES)}",
    "silver_roundtrip": f"WITH {EVENTS}, {RAW}, {SILVER} SELECT * FROM silver",
    "whole_run_overview": f"WITH {EVENTS}, {RAW}, {SILVER}, {_overview('silver')} {WITH_PARTS}",
}

# --- the same over the event table that raw files make ----------------------

LAKE = "lake AS (SELECT *, CAST(created_at AS DATE) AS event_date FROM silver)"


def _over_lake(name: str, day: bool = False, tail: str = "") -> str:
    """A query over the given events as one over the event table, for all days or one."""
    start = f"WITH {EVENTS}"
    body = re.sub(r"\bev\b", "lake", ORACLE[name].removeprefix(start))
    sql = f"{start}, {RAW}, {SILVER}, {LAKE}{body}"
    return f"SELECT * FROM ({sql}) WHERE event_date = {ONE_DAY} {tail}" if day else sql


ORACLE |= {
    "day_by_day_overview": ORACLE["whole_run_overview"],
    "stored_event_hour_distribution": _over_lake("event_hour_distribution_long"),
    "stored_total_events_per_hour": _over_lake("total_events_per_hour"),
    "stored_total_diff_events": _over_lake("total_diff_events"),
    "stored_top_10_real_users": _over_lake("top_10_real_users"),
    "stored_top_3_repo_trend": _over_lake("top_repo_trend_long"),
    "stored_top_3_org_trend": _over_lake("top_org_trend_long"),
    "stored_most_starred_repos": _over_lake("most_starred_repos"),
    "stored_top_3_repos_by_pushes": _over_lake("top_3_repos_by_pushes"),
    "stored_overview_table": _over_lake("overview_table"),
    "first_users_of_day": _over_lake("top_10_real_users", True, "ORDER BY rank_on_that_day, username LIMIT 4"),
    "org_trend_of_day": f"""WITH {EVENTS}, {RAW}, {SILVER}, {LAKE}, {re.sub(r"\bev\b", "lake", _trend("org_name", 5))}
SELECT event_date, hour, """
    + ", ".join(
        f"CAST(coalesce(sum(no_of_events) FILTER (org_name = '{name}'), 0) AS BIGINT) AS {name}" for name in ORG_NAMES
    )
    + f" FROM trend WHERE event_date = {ONE_DAY} GROUP BY event_date, hour",
    "silver_of_day": f"WITH {EVENTS}, {RAW}, {SILVER} SELECT * FROM silver WHERE CAST(created_at AS DATE) = {ONE_DAY}",
    "type_distribution_of_day": _over_lake("event_hour_distribution", True),
    **{
        f"{name}_of_day": _over_lake(name, True)
        for name in (
            "day_trend",
            "peak_hours",
            "starred_cards",
            "pushed_cards",
            "top_users_card",
            "kpi_summary",
            "contribution_breakdown",
            "repo_distribution",
            "rate_band",
            "ratio_reading",
        )
    },
}

KPI_COLUMNS = (
    "no_of_unique_users",
    "total_events",
    "pr_merge_rate",
    "issue_pr_activity_ratio_daily",
    "no_of_unique_repos_modified",
    "no_of_unique_organizations",
    "avg_events_per_user",
    "pr_merge_band",
    "issue_pr_reading",
)
ORACLE |= {
    "late_hour_overview": ORACLE["whole_run_overview"],
    "rejected_events": f"""WITH {EVENTS}, {RAW}
SELECT event_id, concat(event_date, '-', hour(created_at), '.json.gz') AS file,
  CASE WHEN CAST(event_id AS BIGINT) % 389 = 0 THEN 'malformed' WHEN username IS NULL THEN 'incomplete' ELSE 'undated' END AS reason
FROM raw WHERE CAST(event_id AS BIGINT) % 389 = 0 OR username IS NULL OR CAST(event_id AS BIGINT) % 401 = 0""",
    "payload_members": f"""WITH {EVENTS}, {RAW}
SELECT type, CASE type WHEN 'IssuesEvent' THEN 'OBJECT<action: STRING, issue: OBJECT<id: BIGINT>>'
    WHEN 'PullRequestEvent' THEN 'OBJECT<action: STRING, pull_request: OBJECT<id: BIGINT>>'
    WHEN 'IssueCommentEvent' THEN 'OBJECT<action: STRING, comment: OBJECT<body: STRING, id: BIGINT, user: OBJECT<login: STRING>>>'
    ELSE 'OBJECT<>' END AS members, count(*) AS n
FROM raw GROUP BY type""",
    "flow_metrics_variant": f"""WITH {EVENTS}, {RAW}
SELECT CAST(created_at AS DATE) AS event_date, {FLOW} FROM kept GROUP BY 1""",
    "events_of_owner_clustered": f"""WITH {EVENTS}, {RAW}, {SILVER}
SELECT event_id, type, repo FROM silver WHERE type = 'PullRequestEvent' AND repo LIKE 'owner3/%'""",
    "kpi_summary_or_empty": f"""SELECT event_date, k.total_events IS NOT NULL AS has_data, {", ".join(KPI_COLUMNS)}
FROM (VALUES ({ONE_DAY}), (DATE '2024-01-16'), (DATE '2030-01-01')) asked(event_date)
LEFT JOIN ({_over_lake("kpi_summary")}) k USING (event_date)""",
    "evolving_trend": f"""SELECT * FROM (WITH {EVENTS}, {RAW}, {SILVER}, {LAKE}, {re.sub(r"\bev\b", "lake", _trend("org_name", 5))}
{_pivot("org_name", ORG_NAMES)}) WHERE event_date IN ({ONE_DAY}, DATE '2024-01-16')""",
    "events_of_top_repos_stored": f"""WITH {EVENTS}, {RAW}, {SILVER}, {LAKE},
{re.sub(r"\bev\b", "lake", _top("repo_name", 3, "total"))},
days AS (SELECT event_date, count(*) AS n FROM lake GROUP BY event_date)
SELECT event_date, event_id, repo_name, type FROM lake SEMI JOIN top USING (event_date, repo_name)
SEMI JOIN (SELECT event_date FROM days WHERE n >= (SELECT avg(n) FROM days)) busy USING (event_date)""",
    "adhoc_human_events": f"""WITH {EVENTS}, {RAW}, {SILVER}
SELECT event_id, username, repo_owner AS owner, date_trunc('hour', created_at) AS hour FROM silver WHERE {HUMAN}""",
    "adhoc_top_of_day": f"""WITH {EVENTS}, {RAW}, {SILVER}
SELECT repo_name AS name, count(*) AS no_of_events FROM silver
WHERE CAST(created_at AS DATE) = {ONE_DAY} AND repo_name IS NOT NULL GROUP BY repo_name ORDER BY 2 DESC, 1 LIMIT 3""",
    "adhoc_bands": f"""SELECT event_date, pr_merged_rate AS merged, {_band("pr_merged_rate")} AS band
FROM ({_over_lake("overview_table")})""",
}
