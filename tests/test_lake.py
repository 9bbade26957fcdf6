"""Stored summaries: writing, reading, repeating, and whole runs."""

import datetime as dt

import pytest
from conftest import SF_DIR, details, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from test_bronze_to_silver import DAY, event, put

from tidemark import operators as op
from tidemark.fixtures import bronze_root
from tidemark.plans import daily
from tidemark.plans.queries import QUERIES, busiest_sql
from tidemark.schemas import GOLD_TABLES
from tidemark.sources import (
    built_hours,
    day_exists,
    day_partition,
    read_silver,
    read_table,
    read_wide,
    register_table,
    register_views,
    run_sql,
    write_partitioned,
)

ONE = dt.date(2024, 1, 7)
NEXT, AFTER = dt.date(2024, 3, 11), dt.date(2024, 3, 12)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """All days built from raw files."""
    root = str(tmp_path_factory.mktemp("lake"))
    daily.run_all(spark, bronze_root(spark, SF_DIR), lake=root)
    return root


@pytest.mark.parametrize("name", GOLD_TABLES)
def test_stored_summary_equals_the_operator(spark, lake, name):
    events = read_silver(spark, lake)
    unsaved = {
        "event_hour_distribution": op.hourly_type_counts,
        "total_events_per_hour": op.events_per_hour,
        "total_diff_events": op.events_per_type,
        "top_10_real_users": op.top_real_users,
        "top_3_repo_trend": lambda ev: op.trend_long(ev, "repo_name", 3),
        "top_3_org_trend": lambda ev: op.trend_long(ev, "org_name", 5),
        "most_starred_repos": op.most_starred,
        "top_3_repos_by_pushes": op.most_pushed,
        "overview_table": op.overview,
    }[name](events)
    stored = read_table(spark, lake, name)
    assert {c: t for c, t in stored.dtypes if c not in ("year", "month", "day")} == dict(unsaved.dtypes)
    assert rows(stored, *unsaved.columns) == rows(unsaved)


def test_building_a_day_again_changes_nothing(spark, lake):
    before = {name: rows(read_table(spark, lake, name)) for name in GOLD_TABLES}
    daily.build_gold(spark, lake, ONE)
    assert {name: rows(read_table(spark, lake, name)) for name in GOLD_TABLES} == before


def test_a_day_is_one_file_in_each_summary(spark, lake):
    files = read_table(spark, lake, "total_diff_events", ONE).inputFiles()
    assert len(files) == 1


def test_read_table(spark, lake):
    top = read_table(spark, lake, "top_10_real_users", ONE, order_by=["rank_on_that_day", "username"], limit=2)
    assert [r.rank_on_that_day for r in top.collect()][0] == 1 and top.count() == 2
    overview = read_table(spark, lake, "overview_table", ONE).select("total_events")
    assert all("year=2024/month=1/day=7" in path for path in overview.inputFiles())
    assert "PartitionFilters: [isnotnull(year" in details(overview)
    silver = read_table(spark, lake, "silver_raw", ONE, date_col="created_at", layer="silver")
    assert rows(silver, "event_id") == rows(read_silver(spark, lake, ONE), "event_id")
    assert read_table(spark, lake, "overview_table", "2030-01-01").isEmpty()


def test_day_exists(spark, lake):
    assert day_exists(spark, lake, ONE, "gold", "overview_table")
    assert not day_exists(spark, lake, "2030-01-01", "gold", "overview_table")
    assert not day_exists(spark, "/no/such/root", ONE, "bronze")
    assert not day_exists(spark, "nosuchfs://x", ONE, "bronze")


def test_wide_view(spark, lake):
    wide = read_wide(spark, lake, "top_3_org_trend", ONE)
    tidy = read_table(spark, lake, "top_3_org_trend", ONE)
    names = op.labels_of_day(tidy, "org_name")
    assert wide.columns == ["event_date", "hour", *names] and 0 < len(names) <= 5
    assert sum(v for r in wide.collect() for v in tuple(r)[2:] if v) == sum(r.no_of_events for r in tidy.collect())
    assert "PushEvent" in read_wide(spark, lake, "event_hour_distribution", ONE).columns
    assert read_wide(spark, lake, "event_hour_distribution", names=["PushEvent"]).columns[2:] == ["PushEvent"]
    with pytest.raises(ValueError, match="date or names"):
        read_wide(spark, lake, "event_hour_distribution")


def test_sql_over_the_lake(spark, lake):
    found = run_sql(spark, busiest_sql("repo_name"), lake, day=ONE)
    top = op.top_counted(read_silver(spark, lake), "repo_name", 3, ONE)
    assert rows(found) == rows(top, "repo_name", "no_of_events")
    assert set(register_views(spark, lake)) == {"silver_raw", *GOLD_TABLES}


def test_catalog_table(spark, lake):
    name = register_table(spark, lake, "gold", "overview_table")
    assert spark.table(name).count() == 30
    one = read_table(spark, lake, "overview_table", ONE).drop("year", "month", "day")
    later = one.withColumn("event_date", F.lit(dt.date(2024, 2, 1)))
    write_partitioned(later, lake, "gold", "overview_table")
    register_table(spark, lake, "gold", "overview_table", [day_partition("2024-02-01")])
    register_table(spark, lake, "gold", "overview_table", [day_partition("2024-02-01")])
    assert spark.sql("SELECT * FROM gold.overview_table WHERE event_date = DATE '2024-02-01'").count() == 1
    assert spark.table(name).count() == 31


def test_answers_of_a_day_read_its_folder(spark):
    for name in ("kpi_summary_of_day", "top_users_card_of_day", "day_trend_of_day", "silver_of_day"):
        found = QUERIES[name](spark, SF_DIR)
        assert all("year=2024/month=1/day=15" in path for path in found.inputFiles()), name
        assert "PartitionFilters: [isnotnull(year" in details(found), name


def test_a_day_comes_in_the_order_of_its_summary(spark, lake):
    found = read_table(spark, lake, "total_events_per_hour", ONE).collect()
    assert [r.hour for r in found] == sorted(r.hour for r in found)


def total(spark, root, day):
    found = read_table(spark, root, "overview_table", day).first()
    return found.total_events if found else None


def counts_of(report):
    return {k: v for k, v in report.items() if k in ("date", "built", "rows", "outside_their_day")}


def test_run_day(spark, tmp_path):
    root = str(tmp_path)
    put(tmp_path, 0, [event("1"), event("2"), event("2")])
    assert day_exists(spark, root, DAY, "bronze")
    want = {"date": DAY, "built": True, "rows": 2, "outside_their_day": 0}
    assert counts_of(daily.run_day(spark, root, DAY)) == want
    put(tmp_path, 1, [event("3", at="2024-03-10T01:00:00Z")])
    assert daily.run_day(spark, root, str(DAY))["rows"] == 3
    assert daily.run_day(spark, root, str(DAY)) == {"date": DAY, "built": False}
    assert total(spark, root, DAY) == 3
    assert daily.run_day(spark, root, DAY, force=True)["rows"] == 3
    assert total(spark, root, DAY) == 3
    # A part of a day builds what was there along.
    assert daily.run_day(spark, root, DAY, 0, 1, force=True)["rows"] == 3
    with pytest.raises(ValueError, match="must lie between"):
        daily.run_day(spark, root, "2001-01-01", check_range=True)


def test_an_event_of_tomorrow_does_not_make_tomorrow_built(spark, tmp_path):
    root = str(tmp_path)
    put(tmp_path, 23, [event("1"), event("2", at="2024-03-11T00:00:00Z")])
    daily.run_all(spark, root)
    assert total(spark, root, NEXT) == 1
    put(tmp_path, 0, [event(f"n{i}", at="2024-03-11T05:00:00Z") for i in range(50)], NEXT)
    assert daily.run_day(spark, root, NEXT)["built"]
    assert total(spark, root, NEXT) == 51
    assert daily.run_day(spark, root, DAY) == {"date": DAY, "built": False}


def test_a_part_of_a_day_is_not_the_day(spark, tmp_path):
    root = str(tmp_path)
    put(tmp_path, 0, [event("1"), event("2")])
    put(tmp_path, 5, [event("3", at="2024-03-10T05:00:00Z")])
    assert daily.run_day(spark, root, DAY, 0, 1)["rows"] == 2
    assert built_hours(spark, root, DAY) == {0}
    assert daily.run_day(spark, root, DAY, 0, 1) == {"date": DAY, "built": False}
    assert daily.run_day(spark, root, DAY, 5, 2)["rows"] == 3
    assert built_hours(spark, root, DAY) == {0, 5}
    assert daily.run_day(spark, root, DAY) == {"date": DAY, "built": False}
    assert total(spark, root, DAY) == 3


def test_a_day_without_data_is_not_built(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        daily.build_gold(spark, root, DAY)
    with pytest.raises(AnalysisException):
        daily.run_day(spark, root, DAY)
    assert built_hours(spark, root, DAY) == set()
    put(tmp_path, 0, [event("1")])
    assert daily.run_day(spark, root, DAY)["rows"] == 1


def test_a_run_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    put(tmp_path, 0, [event("1")])
    daily.run_day(spark, root, DAY)
    with monkeypatch.context() as broken:
        broken.setattr(daily, "build_gold", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            daily.run_day(spark, root, DAY, force=True)
    assert daily.run_day(spark, root, DAY)["built"]


def test_an_event_counts_once_however_often_it_comes(spark, tmp_path):
    put(tmp_path, 0, [event("5"), event("6", at="2024-03-11T00:00:00Z")])
    put(tmp_path, 0, [event("6", at="2024-03-11T00:00:00Z")], NEXT)
    put(tmp_path, 0, [event("6", at="2024-03-11T00:00:00Z"), event("8", at="2024-03-11T01:00:00Z")], AFTER)
    root, other = str(tmp_path), str(tmp_path / "other")
    for day in (DAY, NEXT, AFTER):
        daily.run_day(spark, root, day)
    daily.run_all(spark, root, lake=other)
    assert [total(spark, root, d) for d in (DAY, NEXT, AFTER)] == [1, 2, None]
    assert [total(spark, other, d) for d in (DAY, NEXT, AFTER)] == [1, 2, None]


def test_ways_of_building_agree(spark, tmp_path):
    """All days at once, day by day, and in another order: every summary is the same."""
    people = ["ann", "bob", "cy", "x[bot]"]
    for day, files in ((DAY, (0, 3, 23)), (NEXT, (0, 1)), (AFTER, (2,))):
        for hour in files:
            lines = []
            for i in range(12):
                n = (day.day * 7 + hour + i) % 40
                when = day + dt.timedelta(days=(n % 5 == 0) - (n % 7 == 0))
                kind = ["PushEvent", "WatchEvent", "IssuesEvent", "PullRequestEvent"][n % 4]
                payload = {"action": "opened", "issue": {"id": n}, "pull_request": {"id": n}}
                lines.append(event(str(n), f"{when}T{hour:02}:00:00Z", type=kind, payload=payload, org={"id": 1, "login": f"o{n % 3}"},
                                   actor={"id": 1, "login": people[n % 4]}, repo={"id": 1, "name": f"own/r{n % 5}"}))
            put(tmp_path, hour, lines, day)
    root = str(tmp_path)
    ways = {name: f"{root}/{name}" for name in ("all", "forward", "backward")}
    daily.run_all(spark, root, lake=ways["all"])
    for day in (DAY, NEXT, AFTER):
        daily.run_day(spark, root, day, lake=ways["forward"])
    for day in (AFTER, NEXT, DAY):
        daily.run_day(spark, root, day, lake=ways["backward"])
    for name in GOLD_TABLES:
        want = rows(read_table(spark, ways["all"], name))
        assert want, name
        assert rows(read_table(spark, ways["forward"], name)) == want, name
        assert rows(read_table(spark, ways["backward"], name)) == want, name


def test_what_cleaning_removed(spark, tmp_path):
    root = str(tmp_path)
    lines = [event("1"), event("1"), "junk", "{}", event("2", at="no time"), event("3", type=None), event(None), event("4", payload=None)]
    put(tmp_path, 0, lines)
    got = daily.run_day(spark, root, DAY)
    want = {"lines": 8, "malformed": 2, "copies": 1, "incomplete": 3, "undated": 1, "rows": 1, "outside_their_day": 0}
    assert got == {"date": DAY, "built": True, **want}
    assert read_table(spark, root, "overview_table").where("event_date is null").isEmpty()
    assert total(spark, root, DAY) == 1
