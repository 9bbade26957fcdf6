"""Operators on hand-made rows, one hazard at a time."""

import datetime as dt

import pytest
from conftest import DAY, SF_DIR, plan, rows
from pyspark.sql import functions as F

from tidemark import operators as op
from tidemark.fixtures import activity_events
from tidemark.plans.queries import QUERIES
from tidemark.functions import is_human, rate_band, ratio_reading, safe_pct


def at(hour, minute=0, day=10):
    return dt.datetime(2024, 3, day, hour, minute)


def test_bots(make_events):
    names = ["dependabot[bot]", "x[bot]y", "x-bot", "Copilot", "robot", "bot-x", "copilot", "x-BOT", None]
    kept = make_events([{"username": n} for n in names]).where(is_human())
    assert rows(kept, "username") == [("bot-x",), ("copilot",), ("robot",), ("x-BOT",)]


def test_ties_at_the_cut_go_by_name_and_share_a_rank(make_events):
    events = make_events([{"username": n} for n in ["d", "c", "b", "a", "z", "z", "q-bot"] + ["q-bot"] * 9])
    top = op.top_real_users(events, k=3)
    assert rows(top, "username", "no_of_Events_per_user", "rank_on_that_day") == [("a", 1, 2), ("b", 1, 2), ("z", 2, 1)]


def test_top_k_beyond_the_pruned_size_is_exact(make_events):
    events = make_events([{"username": f"u{i}"} for i in range(1300)] + [{"username": "u7"}] * 3)
    assert op.top_k(events, "username", 1200).count() == 1200
    assert op.top_k(events, "username", 5000).count() == 1300
    best = op.top_k(events, "username", 1200).orderBy(F.desc("no_of_events")).first()
    assert (best.username, best.no_of_events) == ("u7", 4)
    with pytest.raises(ValueError):
        op.top_k(events, "username", 0)


def test_one_form_for_every_k(make_events):
    events = make_events([{"username": f"u{i % 40}"} for i in range(100)])
    for k in (1, 7, 39, 40, 5000):
        want = sorted(((-(3 if i < 20 else 2), f"u{i}") for i in range(40)))[:k]
        assert sorted((-n, u) for u, n in rows(op.top_k(events, "username", k), "username", "no_of_events")) == want


def test_top_k_prunes_before_a_day_comes_together(make_events):
    events = make_events([{}])
    text = plan(op.top_repos(events))
    assert "Final" in text and "Partial" in text
    assert "partial_count" in text


def test_repo_names_merge_owners_and_may_be_missing(make_events):
    events = make_events([{"repo": r} for r in ["a/x", "b/x", "c/y", "noslash", "noslash", "noslash"]])
    assert rows(op.top_repos(events, 2), "repo_name", "no_of_events") == [("x", 2), (None, 3)]
    assert rows(op.top_repos(events, 1, key="repo"), "repo") == [("noslash",)]
    # The missing name takes a place but has no trend, in both ways of finding the names.
    for date in (None, DAY):
        assert rows(op.trend_long(events, "repo_name", 2, date), "repo_name", "no_of_events") == [("x", 2)]
    assert rows(op.top_counted(events, "repo_name", 9), "repo_name", "no_of_events") == [("x", 2), ("y", 1), (None, 0)]


def test_starred(make_events):
    events = make_events([{"repo": r, "type": "WatchEvent"} for r in ["a/x", "a/x", "noslash"]] + [{"repo": "p/p"}])
    assert rows(op.most_starred(events), "repo", "repo_owner", "repo_name", "no_of_watchers") == [
        ("a/x", "a", "x", 2),
        ("noslash", "noslash", None, 1),
    ]


def test_leaders_keep_ties_and_hours_apart(make_events):
    made = [("a/x", 1), ("a/x", 1), ("b/y", 1), ("b/y", 1), ("c/z", 1), ("c/z", 2)]
    events = make_events([{"repo": r, "created_at": at(h, 59)} for r, h in made])
    want = [(at(1), "x", 2), (at(1), "y", 2), (at(2), "z", 1)]
    for date in (None, DAY):
        assert rows(op.leaders_per_hour(events, date=date)) == want


def test_hours_without_events_are_absent(make_events):
    events = make_events([{"created_at": at(0)}, {"created_at": at(23, 59)}])
    assert rows(op.events_per_hour(events), "hour", "no_of_events") == [(0, 1), (23, 1)]


def test_distribution_finds_its_types(make_events):
    events = make_events([{"type": "B", "created_at": at(1)}, {"type": "A", "created_at": at(2)}, {"type": "A", "created_at": at(2)}])
    wide = op.event_hour_distribution(events)
    assert wide.columns == ["event_date", "hour", "A", "B"]
    assert rows(wide, "hour", "A", "B") == [(1, None, 1), (2, 2, None)]
    assert op.event_hour_distribution(events, types=["B", "C"]).columns == ["event_date", "hour", "B", "C"]


def overview_of(events, date=None):
    row = op.overview(events, date).first()
    return row.asDict() if row else None


def test_overview_counts(make_events):
    pr = {"type": "PullRequestEvent"}
    events = make_events(
        [
            {**pr, "action": "opened", "pr_id": 1, "public": True},
            {**pr, "action": "opened", "pr_id": 1, "public": False},
            {**pr, "action": "opened", "pr_id": 2, "public": None, "repo": "q/r"},
            {**pr, "action": "opened", "pr_id": 3, "username": None},
            {**pr, "action": "opened", "pr_id": None},
            {**pr, "action": "merged", "pr_id": 2, "org_name": "o"},
            {**pr, "action": "closed", "pr_id": 2, "org_name": "o"},
            {**pr, "action": "closed", "pr_id": 9, "org_name": "p"},
            {**pr, "action": "reopened", "pr_id": 10},
            {"type": "IssuesEvent", "action": "opened", "issue_id": 5},
            {"type": "IssuesEvent", "action": "opened", "issue_id": 5},
            {"type": "IssuesEvent", "action": "closed", "issue_id": 6},
            {"type": "PushEvent", "action": "opened", "issue_id": 7, "pr_id": 8},
        ]
    )
    row = overview_of(events)
    assert row == {
        "event_date": DAY,
        "no_of_unique_users": 1,
        "no_of_unique_repos_modified": 2,
        "total_public_repo": 1,
        "total_private_repo": 1,
        "no_of_unique_organizations": 2,
        "total_events": 13,
        "issues_opened": 1,
        "prs_created": 3,
        "prs_merged": 1,
        "prs_closed": 2,
        "issue_pr_activity_ratio_daily": 33.33,
        "pr_merge_rate": 66.67,
        "pr_merged_rate": 33.33,
    }
    # The parts say the same, also of members of nested events, and days of other events stay.
    parts = [*op.activity_metrics(events).collect(), *op.flow_metrics(events).collect()]
    assert [p.event_date for p in parts] == [DAY] * 2 and row == row | parts[0].asDict() | parts[1].asDict()
    nested = events.withColumn("payload", F.struct(F.col("issue_id").alias("i"), F.col("pr_id").alias("p"), "action"))
    nested = op.flow_metrics(nested.drop("issue_id", "pr_id", "action"), None, "payload.i", "payload.p", "payload.action")
    assert nested.first() == parts[1]
    assert rows(op.flow_metrics(make_events([{}]))) == [(DAY, 0, 0, 0, 0)]


def test_wanted_counts_read_what_they_need(make_events):
    events = make_events([{"type": "IssuesEvent", "action": "opened", "issue_id": 1}, {"created_at": at(1, day=11)}])
    some = op.with_ratios(op.overview_counts(events, wanted=("issues_opened",)))
    assert rows(some) == [(DAY, 1), (dt.date(2024, 3, 11), 0)]
    text = plan(op.overview_counts(activity_events(events.sparkSession, SF_DIR), wanted=("issues_opened",)))
    assert text.split("Initial Plan")[-1].count("FileScan") == 2 and "user_id" not in text


def test_no_registered_query_multiplies_events(spark):
    """Distinct counts are made by grouping, not by copying every event."""
    for name in ("overview_table", "activity_metrics", "flow_metrics", "flow_metrics_nested", "rate_band"):
        assert "Expand" not in plan(QUERIES[name](spark, SF_DIR)), name


def test_overview_of_days_without_pull_requests_or_events(make_events):
    row = overview_of(make_events([{}]))
    assert (row["prs_created"], row["issue_pr_activity_ratio_daily"], row["pr_merge_rate"]) == (0, 0.0, 0.0)
    empty = overview_of(make_events([{}]), "2024-05-01")
    assert empty["event_date"] == dt.date(2024, 5, 1)
    assert {v for k, v in empty.items() if k != "event_date"} == {0}
    assert overview_of(make_events([])) is None
    averages = op.avg_events_per_user(op.overview(make_events([]), "2024-05-01"))
    assert averages.first().avg_events_per_user == 0.0


def test_trend_names_with_dots_case_and_clashes(make_events):
    repos = ["a/x.js", "a/x.js", "a/Foo", "a/foo", "a/foo", "a/hour", "a/hour"]
    events = make_events([{"repo": r, "created_at": at(i % 2)} for i, r in enumerate(repos)])
    tidy = op.trend_long(events, "repo_name", 4)
    names = op.labels_of_day(tidy, "repo_name")
    assert names == ["Foo", "foo", "hour", "x.js"]
    filled = op.trend_filled(tidy, names)
    assert filled.columns == ["event_date", "hour", "Foo", "foo", "hour", "x.js"]
    assert [tuple(r)[1:] for r in filled.collect()] == [(at(0), 1, 1, 1, 1), (at(1), 0, 1, 1, 1)]
    wide = op.trend_wide(tidy, "repo_name", ["x.js"])
    assert op.select_columns(wide, ["hour", "x.js"]).columns == ["hour", "x.js"]


def test_filled_trend_keeps_hours_of_names_nobody_asked_for(make_events):
    made = [("a/x", 1, 10), ("a/x", 1, 10), ("a/y", 2, 10), ("a/x", 3, 11), ("a/y", 3, 11), ("a/y", 3, 11)]
    events = make_events([{"repo": r, "created_at": at(h, day=d)} for r, h, d in made])
    tidy = op.trend_long(events, "repo_name", 2)
    one = op.trend_filled(tidy, ["x"], DAY)
    assert [tuple(r)[1:] for r in one.collect()] == [(at(1), 2), (at(2), 0)]
    by_day = op.trend_filled(tidy, ["x", "y"], asked=op.top_counted(events, "repo_name", 1))
    assert [tuple(r)[1:] for r in by_day.collect()] == [(at(1), 2, 0), (at(2), 0, 0), (at(3, day=11), 0, 2)]


def test_trend_without_names(make_events):
    tidy = op.trend_long(make_events([{"org_name": None}]), "org_name", 5)
    assert op.labels_of_day(tidy, "org_name") == []
    assert op.trend_filled(tidy, [], key="org_name").isEmpty()


def test_trend_ways_agree(spark):
    events = activity_events(spark, SF_DIR)
    top = op.top_repos(events)
    want = rows(op.trend_long(events, "repo_name", 3))
    assert rows(op.trend_of(events, top, "repo_name")) == want
    # A name that is given several times counts once.
    assert rows(op.trend_of(events, top.union(top), "repo_name")) == want
    kept = op.keep_top(events, top.union(top), ["event_date", "repo_name"])
    assert rows(kept) == rows(events.join(top, ["event_date", "repo_name"], "left_semi").select(kept.columns))
    assert kept.columns == events.columns


def test_trend_reads_events_once_and_prunes(spark):
    text = plan(op.trend_long(activity_events(spark, SF_DIR), "repo_name", 3))
    assert text.count("FileScan") == 1 and text.count("WindowGroupLimit") == 4


def test_many_days_join_counts_not_events(spark):
    events = activity_events(spark, SF_DIR)
    text = plan(op.trend_of(events, op.top_repos(events), "repo_name"))
    join = text.index("Join")
    assert text.index("HashAggregate", join) < text.index("FileScan", join)


SUMMARIES = {
    "hours": op.events_per_hour,
    "types": op.events_per_type,
    "hour_types": op.hourly_type_counts,
    "exact": op.events_by_type_and_time,
    "overview": op.overview,
    "users": op.top_real_users,
    "repos": op.top_repos,
    "orgs": op.top_orgs,
    "starred": op.most_starred,
    "pushed": op.most_pushed,
    "counted": lambda ev, date=None: op.top_counted(ev, "org_name", 3, date),
    "repo_trend": lambda ev, date=None: op.trend_long(ev, "repo_name", 3, date),
    "org_trend": lambda ev, date=None: op.trend_long(ev, "org_name", 5, date),
    "wide": lambda ev, date=None: op.event_hour_distribution(ev, date, ["PushEvent"]),
}


@pytest.mark.parametrize("name", SUMMARIES)
def test_one_day_equals_that_day_of_all(spark, name):
    events = activity_events(spark, SF_DIR)
    summary = SUMMARIES[name]
    one = rows(summary(events, date="2024-01-07"))
    assert one and one == rows(summary(events).where("event_date = DATE '2024-01-07'"))


def test_totals_agree(spark):
    events = activity_events(spark, SF_DIR)
    total = events.count()
    for counts, column in (
        (op.events_per_hour(events), "no_of_events"),
        (op.events_per_type(events), "no_of_events"),
        (op.overview(events), "total_events"),
    ):
        assert counts.agg(F.sum(column)).first()[0] == total
    split = F.col("total_public_repo") + F.col("total_private_repo") >= F.col("no_of_unique_repos_modified")
    assert op.overview(events).where(~split).isEmpty()
    assert op.top_real_users(events).where("rank_on_that_day = 1").select("event_date").distinct().count() == 30


def test_cards(make_events):
    events = make_events([{"username": n} for n in "aaaabbbccdddeff"])
    cards = op.top_users_card(op.top_real_users(events))
    assert rows(cards, "position", "mark", "username", "rank_on_that_day") == [
        (1, "🥇", "a", 1),
        (2, "🥈", "b", 2),
        (3, "🥉", "d", 2),
        (4, "#4", "c", 3),
        (5, "#5", "f", 3),
    ]
    with pytest.raises(ValueError, match="rank_on_that_day"):
        op.top_users_card(events)
    peaks = op.peak_hours(op.events_per_hour(make_events([{"created_at": at(h)} for h in (3, 3, 9, 1, 5)])))
    assert rows(peaks, "position", "label", "no_of_events") == [(1, "3:00", 2), (2, "1:00", 1), (3, "5:00", 1)]


def test_breakdowns(make_events):
    overview = op.overview(make_events([{"public": False}, {}]))
    assert rows(op.breakdown(overview, op.REPO_KINDS), "label", "value") == [("Private Repos", 1), ("Public Repos", 1)]
    assert rows(op.breakdown(overview, date=DAY), "label") == sorted((v,) for v in op.CONTRIBUTIONS.values())


def test_bands_and_readings(spark):
    bands = spark.createDataFrame([(100.0,), (80.0,), (79.99,), (50.0,), (49.99,), (0.0,), (None,)], "r double")
    assert [r[0] for r in bands.select(rate_band("r")).collect()] == [
        "high", "high", "medium", "medium", "low", "low", None,
    ]
    pairs = spark.createDataFrame([(20, 10), (10, 10), (11, 10), (5, 10), (3, 0)], "i long, p long")
    assert [r[0] for r in pairs.select(ratio_reading("i", "p")).collect()] == [
        "backlog growing", "balanced", "balanced", "backlog shrinking", None,
    ]
    assert [r[0] for r in pairs.select(safe_pct("i", "p")).collect()] == [200.0, 100.0, 110.0, 50.0, 0.0]


def test_small_helpers(make_events):
    events = make_events([{}])
    assert op.require_columns(events, ["repo"]) is events
    assert rows(op.drop_incomplete(events.withColumn("x", F.lit(None)), ["repo", "x"])) == []
