"""Every query by name, over the given tables."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import operators as op
from tidemark.fixtures import (
    EVENT_TYPES,
    ORG_NAMES,
    REPO_NAMES,
    activity_events,
    bronze_root,
    deliver,
    new_root,
    query_root,
    raw_events,
    raw_lines,
)
from tidemark.functions import is_human, rate_band, ratio_reading, utc_wall_clock
from tidemark.params import hour_window
from tidemark.plans import daily
from tidemark.schemas import DAY_PARTS, GOLD_TABLES
from tidemark.sources import (
    day_exists,
    infer_bronze,
    read_bronze,
    read_evolving,
    read_lines,
    read_silver,
    read_silver_on,
    read_table,
    read_wide,
    register_functions,
    register_views,
    run_sql,
    write_partitioned,
    write_wide,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ONE_DAY = "2024-01-15"


def busiest_sql(column: str) -> str:
    """The ad-hoc question for the three values of a column that most events of a day have."""
    return (
        f"SELECT {column}, count({column}) AS no_of_events FROM silver_raw "
        f"WHERE created_at >= :day AND created_at < :day + INTERVAL 1 DAY "
        f"GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 3"
    )


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def _on_events(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(activity_events(spark, sf_dir))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as a scan would give them, without going through files."""
    events = raw_events(spark, sf_dir).drop("event_date")
    return events.withColumn("created_at", F.to_timestamp("created_at"))


# --- raw events to the event table ---------------------------------------


@query("bronze_scan")
def _bronze_scan(spark, sf_dir):
    raw = read_bronze(spark, bronze_root(spark, sf_dir))
    return raw.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("actor.login").alias("with_login"),
        F.count("payload.comment.body").alias("with_comment"),
        F.count_if(F.col("source_file").endswith(".json.gz")).alias("with_source"),
    )


@query("bronze_hours")
def _bronze_hours(spark, sf_dir):
    """The files of six hours of a day, which is the feature."""
    raw = read_bronze(spark, bronze_root(spark, sf_dir), ONE_DAY, hour_window(6, 6), extra=())
    return raw.select(F.col("id").alias("event_id"), "type", F.regexp_extract("source_file", "[^/]+$", 0).alias("file"))


@query("bronze_inferred")
def _bronze_inferred(spark, sf_dir):
    raw = infer_bronze(spark, f"{bronze_root(spark, sf_dir)}/bronze")
    return raw.select(F.col("id").alias("event_id"), "type", F.col("repo.name").alias("repo"), "payload.action")


@query("silver_flatten")
def _silver_flatten(spark, sf_dir):
    raw = read_bronze(spark, bronze_root(spark, sf_dir), extra=())
    return daily.silver_frame(raw).drop("source_file")


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select(
        F.col("id").alias("event_id"),
        "type",
        utc_wall_clock("created_at").alias("created_at"),
        F.col("actor.login").alias("username"),
        F.col("repo.name").alias("repo"),
    )


@query("dedupe_events")
def _dedupe_events(spark, sf_dir):
    kept = op.dedupe(_projected(spark, sf_dir), ["event_id"], order=["created_at"])
    return kept.select("event_id", "type", "created_at")


@query("null_checked_events")
def _null_checked_events(spark, sf_dir):
    kept = op.dedupe(_projected(spark, sf_dir), ["event_id"], order=["created_at"])
    return op.drop_incomplete(kept, ["event_id", "type", "username", "repo"]).select("event_id", "type", "username")


_on_events("silver_day", lambda ev: op.on_day(ev, ONE_DAY))
_on_events("human_events", lambda ev: ev.where(is_human("username")).select("event_id", "username"))

# --- counts ----------------------------------------------------------------

_on_events("events_by_type_and_time", op.events_by_type_and_time)
_on_events("event_hour_distribution", lambda ev: op.event_hour_distribution(ev, types=EVENT_TYPES))
_on_events("event_hour_distribution_long", op.hourly_type_counts)
_on_events("total_events_per_hour", op.events_per_hour)
_on_events("total_diff_events", op.events_per_type)
_on_events("activity_metrics", op.activity_metrics)
_on_events("flow_metrics", op.flow_metrics)
_on_events("overview_table", op.overview)


@query("flow_metrics_nested")
def _flow_metrics_nested(spark, sf_dir):
    members = {"issue": "payload.issue.id", "pr": "payload.pull_request.id", "action": "payload.action"}
    return op.flow_metrics(raw_events(spark, sf_dir), **members)


@query("payload_members")
def _payload_members(spark, sf_dir):
    """All members that payloads have, by event type, whether the schema of raw events has them or not."""
    return op.payload_members(op.variant_events(read_lines(spark, [f"{bronze_root(spark, sf_dir)}/bronze"])))


@query("flow_metrics_variant")
def _flow_metrics_variant(spark, sf_dir):
    events = op.variant_events(read_lines(spark, [f"{bronze_root(spark, sf_dir)}/bronze"]))
    return op.flow_metrics(op.variant_members(events))


# --- rankings --------------------------------------------------------------

_on_events("top_10_real_users", op.top_real_users)
_on_events("top_repo_per_hour", op.leaders_per_hour)
_on_events("top_repos", op.top_repos)
_on_events("top_repos_with_owner", lambda ev: op.top_repos(ev, key="repo"))
_on_events("top_orgs", op.top_orgs)
_on_events("most_starred_repos", op.most_starred)
_on_events("top_3_repos_by_pushes", op.most_pushed)
_on_events("top_counted_repos", lambda ev: op.top_counted(ev, "repo_name"))
_on_events("top_counted_orgs", lambda ev: op.top_counted(ev, "org_name"))


def _adhoc(column: str) -> Query:
    def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
        activity_events(spark, sf_dir).createOrReplaceTempView("silver_raw")
        return run_sql(spark, busiest_sql(column), day=dt.date.fromisoformat(ONE_DAY))

    return ask


QUERIES["adhoc_top_repos"] = _adhoc("repo_name")
QUERIES["adhoc_top_orgs"] = _adhoc("org_name")

# --- trends ----------------------------------------------------------------

_on_events("top_repo_trend_long", lambda ev: op.trend_long(ev, "repo_name", 3))
_on_events("top_org_trend_long", lambda ev: op.trend_long(ev, "org_name", 5))


@query("events_of_top_repos")
def _events_of_top_repos(spark, sf_dir):
    events = activity_events(spark, sf_dir)
    kept = op.keep_top(events, op.top_repos(events), ["event_date", "repo_name"])
    return kept.select("event_date", "event_id", "repo_name", "type")


_on_events("top_3_repo_trend", lambda ev: op.trend_wide(op.trend_long(ev, "repo_name", 3), "repo_name", REPO_NAMES))
_on_events("top_3_org_trend", lambda ev: op.trend_wide(op.trend_long(ev, "org_name", 5), "org_name", ORG_NAMES))


def _filled(ev: DataFrame, key: str, k: int, names: Sequence[str]) -> DataFrame:
    """The trend of the three names per day that a dashboard asks for."""
    asked = op.top_counted(ev.where(F.col(key).isNotNull()), key, 3)
    return op.trend_filled(op.trend_long(ev, key, k), names, key=key, asked=asked)


_on_events("repo_trend_filled", lambda ev: _filled(ev, "repo_name", 3, REPO_NAMES))
_on_events("org_trend_filled", lambda ev: _filled(ev, "org_name", 5, ORG_NAMES))

# --- dashboard answers -----------------------------------------------------


def _bands(overview: DataFrame) -> DataFrame:
    bands = rate_band("pr_merge_rate").alias("merge_band"), rate_band("pr_merged_rate").alias("merged_band")
    return overview.select("event_date", *bands)


def _reading(overview: DataFrame) -> DataFrame:
    return overview.select("event_date", ratio_reading("issues_opened", "prs_created").alias("reading"))


PRS = ("prs_created", "prs_merged", "prs_closed")

_on_events("day_trend", lambda ev: op.day_trend(op.events_per_hour(ev)))
_on_events("peak_hours", lambda ev: op.peak_hours(op.events_per_hour(ev)))
_on_events("starred_cards", lambda ev: op.starred_cards(op.most_starred(ev)))
_on_events("pushed_cards", lambda ev: op.pushed_cards(op.most_pushed(ev)))
_on_events("top_users_card", lambda ev: op.top_users_card(op.top_real_users(ev)))
_on_events("kpi_summary", lambda ev: op.kpi_summary(op.overview(ev)))
_on_events("contribution_breakdown", lambda ev: op.breakdown(op.overview_counts(ev, wanted=tuple(op.CONTRIBUTIONS))))
_on_events(
    "repo_distribution", lambda ev: op.breakdown(op.overview_counts(ev, wanted=tuple(op.REPO_KINDS)), op.REPO_KINDS)
)
_on_events("rate_band", lambda ev: _bands(op.with_ratios(op.overview_counts(ev, wanted=PRS))))
_on_events("ratio_reading", lambda ev: _reading(op.overview_counts(ev, wanted=("issues_opened", "prs_created"))))

# --- storage and whole runs -----------------------------------------------


@query("gold_roundtrip")
def _gold_roundtrip(spark, sf_dir):
    root = query_root(spark, sf_dir, "gold")
    write_partitioned(op.overview(activity_events(spark, sf_dir)), root, "gold", "overview_table")
    return read_table(spark, root, "overview_table")


@query("stored_wide_trend")
def _stored_wide_trend(spark, sf_dir):
    root = query_root(spark, sf_dir, "gold")
    write_partitioned(op.trend_long(activity_events(spark, sf_dir), "org_name", 5), root, "gold", "top_3_org_trend")
    return read_wide(spark, root, "top_3_org_trend", names=ORG_NAMES)


@query("silver_roundtrip")
def _silver_roundtrip(spark, sf_dir):
    lake = query_root(spark, sf_dir, "silver")
    daily.build_silver(spark, bronze_root(spark, sf_dir), lake=lake)
    return read_silver(spark, lake).drop("source_file")


@query("whole_run_overview")
def _whole_run_overview(spark, sf_dir):
    lake = query_root(spark, sf_dir, "whole")
    daily.run_all(spark, bronze_root(spark, sf_dir), lake=lake)
    return read_table(spark, lake, "overview_table")


@query("day_by_day_overview")
def _day_by_day_overview(spark, sf_dir):
    """Day after day from files that hold late events and events of another day's files."""
    root, lake = bronze_root(spark, sf_dir, late=True), query_root(spark, sf_dir, "days")
    days = raw_events(spark, sf_dir).select("event_date").distinct().collect()  # a row per day
    days = {row[0] + dt.timedelta(days=d) for row in days for d in (0, 1)}
    daily.run_days(spark, root, [d for d in days if day_exists(spark, root, d, "bronze")], force=True, lake=lake)
    return read_table(spark, lake, "overview_table")


@query("late_hour_overview")
def _late_hour_overview(spark, sf_dir):
    """The files of each day arrive in three instalments, and each run takes up what is new."""
    root, lines = new_root(spark, "instalments"), raw_lines(spark, sf_dir)
    for hours in (hour_window(8, 8), hour_window(0, 8), hour_window(16, 8)):
        deliver(lines.where(F.col("hour").isin(list(hours))), root)
        daily.run_all(spark, root, force=False)
    return read_table(spark, root, "overview_table")


@query("rejected_events")
def _rejected_events(spark, sf_dir):
    root, lake = bronze_root(spark, sf_dir, damaged=True), query_root(spark, sf_dir, "rejected")
    found = daily.rejected_lines(spark, [f"{root}/bronze"])
    write_partitioned(found, lake, "silver", "rejected", "ingest_date", gather="size", replace_all=True)
    event_id = F.regexp_extract("line", '"id":"([0-9]+)"', 1).alias("event_id")
    return daily.read_rejected(spark, lake).select(event_id, "file", "reason")


CLUSTERED_ROWS = 1 << 20


@query("events_of_owner_clustered")
def _events_of_owner_clustered(spark, sf_dir):
    """The event table in files sorted by type and repository, then the events of a few row groups of it."""
    root = query_root(spark, sf_dir, "clustered")
    events = read_silver(spark, _lake(spark, sf_dir))
    keys = ["type", "repo"]
    write_partitioned(
        events, root, "silver", "silver_raw", "created_at", cluster_by=keys, spread_by=["event_id"], row_group_bytes=CLUSTERED_ROWS, replace_all=True
    )
    owned = (F.col("type") == "PullRequestEvent") & F.col("repo").startswith("owner3/")
    return read_table(spark, root, "silver_raw", layer="silver").where(owned).select("event_id", "type", "repo")


# --- answers from the stored tables ----------------------------------------


def _lake(spark: SparkSession, sf_dir: str) -> str:
    """The tables of all days, built from raw files once per session."""
    return _build_lake(spark, spark.conf.get("spark.app.id", "local"), sf_dir)


@functools.lru_cache(maxsize=None)
def _build_lake(spark: SparkSession, app_id: str, sf_dir: str) -> str:
    lake = query_root(spark, sf_dir, "lake")
    daily.run_all(spark, bronze_root(spark, sf_dir), lake=lake)
    return lake


def _stored(table: str) -> Query:
    return lambda spark, sf_dir: read_table(spark, _lake(spark, sf_dir), table).drop(*DAY_PARTS)


def _answer(table: str, answer: Callable[[DataFrame], DataFrame], limit: int | None = None) -> Query:
    """An answer for one date, from the one day of a stored table, in its order."""

    def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
        return answer(read_table(spark, _lake(spark, sf_dir), table, ONE_DAY, limit=limit))

    return ask


for _name in GOLD_TABLES:
    QUERIES[f"stored_{_name}"] = _stored(_name)

QUERIES["day_trend_of_day"] = _answer("total_events_per_hour", op.day_trend)
QUERIES["peak_hours_of_day"] = _answer("total_events_per_hour", op.peak_hours)
QUERIES["starred_cards_of_day"] = _answer("most_starred_repos", op.starred_cards)
QUERIES["pushed_cards_of_day"] = _answer("top_3_repos_by_pushes", op.pushed_cards)
QUERIES["top_users_card_of_day"] = _answer("top_10_real_users", op.top_users_card)
QUERIES["first_users_of_day"] = _answer("top_10_real_users", lambda t: t.drop(*DAY_PARTS), limit=4)
QUERIES["kpi_summary_of_day"] = _answer("overview_table", op.kpi_summary)
QUERIES["contribution_breakdown_of_day"] = _answer("overview_table", op.breakdown)
QUERIES["repo_distribution_of_day"] = _answer("overview_table", lambda t: op.breakdown(t, op.REPO_KINDS))
QUERIES["rate_band_of_day"] = _answer("overview_table", _bands)
QUERIES["ratio_reading_of_day"] = _answer("overview_table", _reading)
QUERIES["org_trend_of_day"] = _answer("top_3_org_trend", lambda t: op.trend_filled(t, ORG_NAMES, key="org_name"))


@query("silver_of_day")
def _silver_of_day(spark, sf_dir):
    return read_silver(spark, _lake(spark, sf_dir), ONE_DAY).drop("source_file")


@query("type_distribution_of_day")
def _type_distribution_of_day(spark, sf_dir):
    return read_wide(spark, _lake(spark, sf_dir), "event_hour_distribution", ONE_DAY)


ASKED = (ONE_DAY, "2024-01-16", "2030-01-01")


@query("kpi_summary_or_empty")
def _kpi_summary_or_empty(spark, sf_dir):
    """Key figures of three dates, the last without events."""
    return op.answered(op.kpi_summary(read_table(spark, _lake(spark, sf_dir), "overview_table")), ASKED)


@query("evolving_trend")
def _evolving_trend(spark, sf_dir):
    """Two days written wide, each with its own labels, and read as one table."""
    lake = _lake(spark, sf_dir)
    for day in ASKED[:2]:
        write_wide(spark, lake, "top_3_org_trend", day)
    return read_evolving(spark, lake, "top_3_org_trend", names=ORG_NAMES)


@query("events_of_top_repos_stored")
def _events_of_top_repos_stored(spark, sf_dir):
    """Events of each day's top repositories, on the days that had at least as many events as an average day."""
    lake = _lake(spark, sf_dir)
    overview = read_table(spark, lake, "overview_table")
    busy = overview.where(F.col("total_events") >= overview.agg(F.avg("total_events")).scalar())
    events = read_silver_on(spark, lake, busy.select("event_date")).withColumn("event_date", F.make_date(*DAY_PARTS))
    kept = op.keep_top(events, op.top_repos(events), ["event_date", "repo_name"])
    return kept.select("event_date", "event_id", "repo_name", "type")


def _with_functions(sql: str) -> Query:
    """A question in SQL with the package's own functions over the stored tables."""

    def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, _lake(spark, sf_dir))
        register_functions(spark)
        return run_sql(spark, sql, day=dt.date.fromisoformat(ONE_DAY)) if ":day" in sql else run_sql(spark, sql)

    return ask


QUERIES["adhoc_human_events"] = _with_functions(
    "SELECT event_id, username, owner_of(repo) AS owner, hour_start_of(created_at) AS hour FROM silver_raw WHERE is_human(username)"
)
QUERIES["adhoc_top_of_day"] = _with_functions("SELECT name, no_of_events FROM top_of_day('repo_name', :day, 3)")
QUERIES["adhoc_bands"] = _with_functions(
    "SELECT event_date, pct(prs_merged, prs_created) AS merged, band_of(pct(prs_merged, prs_created)) AS band FROM overview_table"
)
