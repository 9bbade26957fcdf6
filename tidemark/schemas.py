"""Column names, types and table layouts shared by the whole package."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

# The nested members of a raw event that the event table reads,
# including the optional ones (see EXTRA_COLUMNS). Members absent from a file
# read as null, so a payload member that no event of the day carries is no error.
PAYLOAD_TYPE = """struct<
  action: string,
  ref: string,
  ref_type: string,
  head: string,
  before: string,
  size: bigint,
  pull_request: struct<
    id: bigint, number: bigint, state: string, title: string,
    user: struct<login: string>, merged: boolean>,
  issue: struct<
    id: bigint, number: bigint, title: string, state: string,
    user: struct<login: string>>,
  comment: struct<id: bigint, body: string, user: struct<login: string>>>"""

BRONZE_SCHEMA = f"""
id string,
type string,
created_at timestamp,
public boolean,
actor struct<id: bigint, login: string, url: string>,
repo struct<id: bigint, name: string, url: string>,
org struct<id: bigint, login: string>,
payload {PAYLOAD_TYPE}
"""

# A raw event without any of these is unusable.
REQUIRED_PATHS = ("id", "type", "actor.login", "repo.name", "payload")

# Event-table columns in order, as (name, type, path in the raw
# event). A path of None marks a column that `flatten` computes.
EVENT_COLUMNS = (
    ("event_id", "string", "id"),
    ("type", "string", "type"),
    ("created_at", "timestamp_ntz", None),
    ("public", "boolean", "public"),
    ("user_id", "bigint", "actor.id"),
    ("username", "string", "actor.login"),
    ("actor_url", "string", "actor.url"),
    ("repo_id", "bigint", "repo.id"),
    ("repo", "string", "repo.name"),
    ("repo_owner", "string", None),
    ("repo_name", "string", None),
    ("repo_url", "string", "repo.url"),
    ("org_id", "bigint", "org.id"),
    ("org_name", "string", "org.login"),
    ("action", "string", "payload.action"),
    ("pr_id", "bigint", "payload.pull_request.id"),
    ("issue_id", "bigint", "payload.issue.id"),
    ("comment_id", "bigint", "payload.comment.id"),
    ("comment_body", "string", "payload.comment.body"),
    ("comment_user", "string", "payload.comment.user.login"),
    ("source_file", "string", "source_file"),
    ("year", "int", None),
    ("month", "int", None),
    ("day", "int", None),
)

# Further payload members that `flatten` projects on request.
EXTRA_COLUMNS = {
    "ref": ("string", "payload.ref"),
    "ref_type": ("string", "payload.ref_type"),
    "head": ("string", "payload.head"),
    "before": ("string", "payload.before"),
    "commit_count": ("bigint", "payload.size"),
    "pr_number": ("bigint", "payload.pull_request.number"),
    "pr_state": ("string", "payload.pull_request.state"),
    "pr_title": ("string", "payload.pull_request.title"),
    "pr_user": ("string", "payload.pull_request.user.login"),
    "pr_merged": ("boolean", "payload.pull_request.merged"),
    "issue_number": ("bigint", "payload.issue.number"),
    "issue_title": ("string", "payload.issue.title"),
    "issue_state": ("string", "payload.issue.state"),
    "issue_user": ("string", "payload.issue.user.login"),
    "payload": (PAYLOAD_TYPE, "payload"),
}

DAY_PARTS = ("year", "month", "day")

# The required members by their names in the event table; a mark stands for the payload.
HAS_PAYLOAD = "_has_payload"
REQUIRED_COLUMNS = ("event_id", "type", "username", "repo", HAS_PAYLOAD)


def bronze_schema(extra: Sequence[str] | None = None) -> str:
    """Schema of raw events with the members that the event table and ``extra`` read, or all of them.

    What the schema leaves out the parser skips.
    """
    if extra is None or "payload" in extra:
        return BRONZE_SCHEMA
    wanted = {path: kind for _, kind, path in EVENT_COLUMNS if path and path != "source_file"}
    wanted |= {"created_at": "timestamp"} | {EXTRA_COLUMNS[name][1]: EXTRA_COLUMNS[name][0] for name in extra}
    tree: dict = {}
    for path, kind in wanted.items():
        *parents, leaf = path.split(".")
        node = tree
        for parent in parents:
            node = node.setdefault(parent, {})
        node[leaf] = kind

    def spelled(node: dict, mark: str) -> str:
        kinds = ((k, f"struct<{spelled(v, ':')}>" if isinstance(v, dict) else v) for k, v in node.items())
        return ", ".join(f"{name}{mark} {kind}" for name, kind in kinds)

    return spelled(tree, "")


SILVER_LAYER = "silver"
SILVER_TABLE = "silver_raw"
INGEST_COLUMN = "ingest_date"
GOLD_LAYER = "gold"

_DAY_DDL = "year int, month int, day int"


def silver_schema(extra: tuple[str, ...] = ()) -> str:
    """Stored schema of the event table: its columns, any extras, the run date."""
    fields = [f"`{name}` {dtype}" for name, dtype, _ in EVENT_COLUMNS if name not in DAY_PARTS]
    fields += [f"`{name}` {EXTRA_COLUMNS[name][0]}" for name in extra]
    return ", ".join([*fields, _DAY_DDL, f"{INGEST_COLUMN} date"])


@dataclass(frozen=True)
class GoldTable:
    """One stored daily summary.

    ``pivot`` names the (label, value) pair that the wide view turns into
    columns. Such tables are stored tidy, because the labels differ by day.
    """

    name: str
    ddl: str
    order_by: tuple[str, ...] = ()
    pivot: tuple[str, str] | None = None

    @property
    def schema(self) -> str:
        return f"event_date date, {self.ddl}, {_DAY_DDL}"


GOLD_TABLES = {
    t.name: t
    for t in (
        GoldTable(
            "event_hour_distribution",
            "hour int, type string, no_of_events bigint",
            ("hour", "type"),
            ("type", "no_of_events"),
        ),
        GoldTable("total_events_per_hour", "hour int, no_of_events bigint", ("hour",)),
        GoldTable("total_diff_events", "type string, no_of_events bigint", ("type",)),
        GoldTable(
            "top_10_real_users",
            "username string, no_of_Events_per_user bigint, rank_on_that_day int",
            ("rank_on_that_day", "username"),
        ),
        GoldTable(
            "top_3_repo_trend",
            "hour timestamp_ntz, repo_name string, no_of_events bigint",
            ("hour", "repo_name"),
            ("repo_name", "no_of_events"),
        ),
        GoldTable(
            "top_3_org_trend",
            "hour timestamp_ntz, org_name string, no_of_events bigint",
            ("hour", "org_name"),
            ("org_name", "no_of_events"),
        ),
        GoldTable(
            "most_starred_repos",
            "repo string, repo_owner string, repo_name string, no_of_watchers bigint",
        ),
        GoldTable("top_3_repos_by_pushes", "repo_name string, no_of_pushes bigint"),
        GoldTable(
            "overview_table",
            "no_of_unique_users bigint, no_of_unique_repos_modified bigint, "
            "total_public_repo bigint, total_private_repo bigint, "
            "no_of_unique_organizations bigint, total_events bigint, "
            "issues_opened bigint, prs_created bigint, prs_merged bigint, prs_closed bigint, "
            "issue_pr_activity_ratio_daily double, pr_merge_rate double, pr_merged_rate double",
        ),
    )
}

OVERVIEW_TABLE = "overview_table"

# Counts that summaries are rolled up from, and lines that were set aside.
COUNTS_LAYER = "counts"
COUNTS_TABLE = "parts"
COUNTS_SCHEMA = (
    "kind string, key string, hour timestamp_ntz, n bigint, n_public bigint, n_private bigint, n_stars bigint, n_pushes bigint, "
    f"prs_created bigint, prs_merged bigint, prs_closed bigint, {_DAY_DDL}, delivered string"
)
REJECTED_TABLE = "rejected"
REJECTED_SCHEMA = f"line string, file string, reason string, {INGEST_COLUMN} date, {_DAY_DDL}"
