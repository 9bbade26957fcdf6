"""Pruning by a table of days, clustered files, wide tables that evolve, SQL functions, variants, answers without data."""

import datetime as dt

import pytest
from conftest import SF_DIR, details, plan, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from test_bronze_to_silver import DAY, event, put

from tidemark import operators as op
from tidemark.fixtures import ORG_NAMES, bronze_root
from tidemark.plans import daily
from tidemark.sources import (
    read_evolving,
    read_lines,
    read_silver,
    read_silver_on,
    read_table,
    register_functions,
    register_views,
    run_sql,
    write_partitioned,
    write_wide,
)

ONE, OTHER = dt.date(2024, 1, 7), dt.date(2024, 1, 8)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    daily.run_all(spark, bronze_root(spark, SF_DIR), lake=root)
    return root


def scanned(df):
    """Rows that the scans of an executed plan gave."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            nodes.append(node.executedPlan())
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
    return total


def test_days_of_a_table_prune_the_scan(spark, lake):
    days = read_table(spark, lake, "overview_table").where(F.col("event_date").isin(ONE, OTHER)).select("event_date")
    found = read_silver_on(spark, lake, days)
    scan = [line for line in details(found).splitlines() if "PartitionFilters" in line and "dynamicpruning" in line]
    assert scan
    want = read_silver(spark, lake).where(F.make_date("year", "month", "day").isin(ONE, OTHER))
    assert rows(found, "event_id") == rows(want, "event_id") and not want.isEmpty()
    everything = read_silver(spark, lake).count()
    assert scanned(found.select("event_id", "type")) < everything / 5
    assert read_silver_on(spark, lake, days.limit(0)).isEmpty()
    assert read_silver_on(spark, lake, days.select(F.lit(None).cast("date").alias("event_date"))).isEmpty()


def test_clustered_files_let_row_groups_be_skipped(spark, tmp_path):
    many = spark.range(200_000).select(
        F.col("id").cast("string").alias("event_id"),
        F.concat(F.lit("T"), F.col("id") % 9).alias("type"),
        # a third of all rows are of one repository
        F.when(F.col("id") % 3 == 0, "hot/hot").otherwise(F.concat(F.lit("o/"), F.xxhash64("id") % 500)).alias("repo"),
        F.lit(dt.datetime(2024, 3, 10, 1)).cast("timestamp_ntz").alias("created_at"),
    )
    root, found = str(tmp_path), {}
    for name, keys in (("plain", ()), ("clustered", ("type", "repo"))):
        write_partitioned(many, root, "silver", name, "created_at", gather="size", cluster_by=keys, row_group_bytes=1 << 16)
        stored = spark.read.parquet(f"{root}/silver/{name}").where("type = 'T4' AND repo = 'o/7'").select("event_id", "type", "repo")
        found[name] = (rows(stored), scanned(stored))
    assert found["plain"][0] == found["clustered"][0] and found["plain"][0]
    assert found["clustered"][1] < 40_000 < 100_000 < found["plain"][1]
    sizes = [r["count"] for r in spark.read.parquet(f"{root}/silver/clustered").groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 2 * 200_000 / 4 and len(sizes) >= 4  # the hot repository went to several files


def test_ranges_of_clustered_files_are_found_in_few_columns(spark, tmp_path):
    """The hash that deals a hot key to several files is of the columns that tell rows apart."""
    many = spark.range(40_000).select(
        F.col("id").cast("string").alias("event_id"),
        F.lit("T").alias("type"),
        F.lit("hot/hot").alias("repo"),
        F.lit("a long body").alias("body"),
        F.lit(dt.datetime(2024, 3, 10, 1)).cast("timestamp_ntz").alias("created_at"),
    )
    root, keys = str(tmp_path), ["type", "repo"]
    with pytest.MonkeyPatch.context() as patch:
        hashed, real = [], F.xxhash64
        patch.setattr(F, "xxhash64", lambda *cols: hashed.append(cols) or real(*cols))
        write_partitioned(many, root, "silver", "spread", "created_at", cluster_by=keys, spread_by=["event_id"])
        write_partitioned(many, root, "silver", "whole", "created_at", cluster_by=keys)
    assert hashed == [("event_id",), tuple(many.columns)]
    for name in ("spread", "whole"):
        stored = spark.read.parquet(f"{root}/silver/{name}")
        sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 20_000
        assert rows(stored, *many.columns) == rows(many)


def test_wide_table_grows_columns(spark, lake):
    names = {day: write_wide(spark, lake, "top_3_org_trend", day) for day in (ONE, OTHER)}
    found = read_evolving(spark, lake, "top_3_org_trend")
    assert set(found.columns) == {"event_date", "hour", *names[ONE], *names[OTHER]}
    for day in (ONE, OTHER):
        own = read_evolving(spark, lake, "top_3_org_trend", day)
        assert own.columns == found.columns
        for name in found.columns[2:]:
            total = own.agg(F.sum(op.cleaning.quoted(name))).first()[0]
            tidy = read_table(spark, lake, "top_3_org_trend", day).where(F.col("org_name") == name).agg(F.sum("no_of_events")).first()[0]
            assert total == tidy
    fixed = read_evolving(spark, lake, "top_3_org_trend", names=[*ORG_NAMES, "nobody"])
    assert fixed.columns == ["event_date", "hour", *ORG_NAMES, "nobody"] and fixed.where("nobody is not null").isEmpty()
    before = rows(fixed.drop("nobody"))
    assert write_wide(spark, lake, "top_3_org_trend", ONE) == names[ONE]
    assert rows(read_evolving(spark, lake, "top_3_org_trend", names=ORG_NAMES)) == before


def test_wide_table_without_days_or_with_labels_that_clash(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(AnalysisException):
        read_evolving(spark, root, "top_3_org_trend")
    assert read_evolving(spark, root, "top_3_org_trend", names=["a.b"]).columns == ["event_date", "hour", "a.b"]
    put(tmp_path, 1, [event("1", org={"id": 1, "login": "Acme"}), event("2", org={"id": 2, "login": "x.y z"})])
    daily.run_day(spark, root, DAY)
    assert sorted(write_wide(spark, root, "top_3_org_trend", DAY)) == ["Acme", "x.y z"]
    assert read_evolving(spark, root, "top_3_org_trend", names=["x.y z"]).first()["x.y z"] == 1
    put(tmp_path, 1, [event("1", org={"id": 1, "login": "Acme"}), event("2", org={"id": 2, "login": "acme"})])
    daily.run_day(spark, root, DAY)
    with pytest.raises(ValueError, match="Acme, acme"):
        write_wide(spark, root, "top_3_org_trend", DAY)


def test_sql_functions(spark, lake):
    register_views(spark, lake)
    names = register_functions(spark)
    assert {"is_human", "top_of_day", "pct"} <= set(names)
    found = run_sql(spark, "SELECT username FROM silver_raw WHERE is_human(username)")
    assert not any(x in plan(found) for x in ("Python", "Arrow"))
    assert found.where("username like '%[bot]' or username like '%-bot' or username = 'Copilot'").isEmpty()
    one = spark.sql("SELECT is_human('a'), is_human('a-bot'), is_human('Copilot'), is_human(NULL), owner_of('o/n'), name_of('o'), pct(1, 3), pct(1, 0), band_of(50.0D), band_of(NULL)").first()
    assert tuple(one) == (True, False, False, None, "o", None, 33.33, 0.0, "medium", None)
    for label in ("repo_name", "org_name", "username", "type"):
        got = run_sql(spark, f"SELECT * FROM top_of_day('{label}', :day, 4)", day=ONE)
        want = op.top_counted(read_silver(spark, lake), label, 5, ONE).where(f"{label} is not null").orderBy(F.desc("no_of_events"), label).limit(4)
        assert rows(got) == rows(want, label, "no_of_events")
    day = run_sql(spark, "SELECT event_id FROM events_of_day(:day)", day=ONE)
    assert rows(day) == rows(read_silver(spark, lake, ONE), "event_id")
    assert "PartitionFilters: [isnotnull(year" in details(day)
    with pytest.raises(Exception, match="no such label"):
        run_sql(spark, "SELECT * FROM top_of_day('nothing', :day, 4)", day=ONE).collect()


def test_payload_as_variant(spark, tmp_path):
    odd = event("1", type="IssuesEvent", payload={"action": "opened", "issue": {"id": 5}, "unlisted": {"deep": [1, {"x": "y"}]}})
    wrong = event("2", type="IssuesEvent", payload={"action": "opened", "issue": {"id": "five"}, "unlisted": 3})
    put(tmp_path, 0, [odd, wrong, event("1", at="2024-03-10T03:00:00Z", type="IssuesEvent"), "junk", "[1]", event("3", payload="text"), event("4", payload=None)])
    found = op.variant_events(read_lines(spark, [f"{tmp_path}/bronze"]))
    assert rows(found, "event_id") == [("1",), ("1",), ("2",), ("3",), ("4",)]
    members = {r.type: (r.members, r.n) for r in op.payload_members(found).collect()}
    assert members["IssuesEvent"] == ("OBJECT<action: STRING, issue: OBJECT<id: VARIANT>, unlisted: VARIANT>", 3)
    deep = op.variant_members(found, {"x": ("$.unlisted.deep[1].x", "string")})
    assert rows(deep, "event_id", "x") == [("1", "y"), ("2", None), ("3", None), ("4", None)]
    assert op.flow_metrics(op.variant_members(found)).first().issues_opened == 1
    assert op.variant_events(spark.createDataFrame([], "line string")).isEmpty()


def test_answers_without_data(spark, lake):
    summary = op.kpi_summary(read_table(spark, lake, "overview_table"))
    got = op.answered(summary, [ONE, "2030-01-01", ONE]).orderBy("event_date").collect()
    assert [(r.event_date, r.has_data) for r in got] == [(ONE, True), (dt.date(2030, 1, 1), False)]
    assert got[0].total_events > 0 and got[1].total_events is None
    several = op.answered(op.peak_hours(read_table(spark, lake, "total_events_per_hour")), [ONE, "2030-01-01"])
    assert several.columns == ["event_date", "has_data", "position", "label", "no_of_events"] and several.count() == 4
    assert op.answered(summary, []).isEmpty()
    clashing = summary.select("event_date", F.lit("x").alias("has_data"), F.lit(1).alias("a.b"))
    assert rows(op.answered(clashing, [ONE])) == [(ONE, True, 1)]
