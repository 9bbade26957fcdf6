import datetime as dt
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF_DIR = "/root/testdata/sf0.001"

EVENT_DDL = (
    "event_id string, type string, created_at timestamp_ntz, public boolean, username string, repo string, "
    "repo_name string, org_name string, action string, pr_id bigint, issue_id bigint"
)
DAY = dt.date(2024, 3, 10)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from tidemark.session import local_session

    SparkSession.builder.config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    session = local_session("tests", 4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def new_york(spark):
    """A session zone with a daylight-saving change on the test day."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture(scope="session")
def make_events(spark):
    """Build flat events from dicts; what a dict leaves out gets a default."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            event = {
                "event_id": str(i),
                "type": "PushEvent",
                "created_at": dt.datetime(2024, 3, 10, 12),
                "public": True,
                "username": "ann",
                "repo": "own/lib",
                "org_name": None,
                "action": None,
                "pr_id": None,
                "issue_id": None,
                **row,
            }
            parts = event["repo"].split("/") if event["repo"] else []
            event.setdefault("repo_name", parts[1] if len(parts) > 1 else None)
            full.append(tuple(event[name.split()[0]] for name in EVENT_DDL.split(", ")))
        return spark.createDataFrame(full, EVENT_DDL)

    return make


def rows(df, *columns):
    """Rows of a result as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def details(df):
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
