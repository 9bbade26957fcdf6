"""Event data derived from the given ``events`` table.

The table has no user names, repositories or payloads, so these are spelled out
from its columns by fixed rules: one flat event per row of the table, or one
nested raw event per row, with damage added for the cleaning operators.
"""

from __future__ import annotations

import functools
import gzip
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

# What each event type of the given table stands for.
TYPES = {
    "click": "PushEvent",
    "view": "WatchEvent",
    "signup": "IssuesEvent",
    "purchase": "PullRequestEvent",
    "error": "IssueCommentEvent",
}
EVENT_TYPES = sorted(TYPES.values())

# Every 50th event is delivered twice, every 97th lacks its actor.
COPY_EVERY = 50
DAMAGE_EVERY = 97
# In late files every 211th event comes a day late, every 307th with two days' files.
LATE_EVERY = 211
TWICE_EVERY = 307
# In damaged files every 389th line is cut in half, and every 401st has no readable time.
CUT_EVERY = 389
UNTIMED_EVERY = 401
# The names that the rules below make.
REPO_NAMES = tuple(f"repo{i}" for i in range(20))
ORG_NAMES = tuple(f"org{i}" for i in (1, 2, 4, 5, 7, 8))


def _text(prefix: str, number: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), number.cast("string"), F.lit(suffix))


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given events as flat activity events."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    event_id, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    k = F.col("k")
    event_type = F.lit(TYPES["error"])
    for given, meant in TYPES.items():
        if given != "error":
            event_type = F.when(kind == given, meant).otherwise(event_type)
    third = event_id % 3
    tenth = F.floor(event_id / 10).cast("bigint")
    has_org = k % 3 != 0
    return source.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")).select(
        event_id.cast("string").alias("event_id"),
        event_type.alias("type"),
        F.col("ts").alias("created_at"),
        (event_id % 10 != 0).alias("public"),
        user.alias("user_id"),
        F.when(user % 10 == 0, _text("user", user, "[bot]"))
        .when(user % 10 == 1, _text("user", user, "-bot"))
        .when(user == 2, F.lit("Copilot"))
        .otherwise(_text("user", user))
        .alias("username"),
        k.alias("repo_id"),
        F.concat(_text("owner", k % 7), F.lit("/"), _text("repo", k % 20)).alias("repo"),
        _text("owner", k % 7).alias("repo_owner"),
        _text("repo", k % 20).alias("repo_name"),
        F.when(has_org, k % 9).alias("org_id"),
        F.when(has_org, _text("org", k % 9)).alias("org_name"),
        F.when(kind == "signup", F.when(event_id % 2 == 0, "opened").otherwise("closed"))
        .when(kind == "purchase", F.when(third == 0, "opened").when(third == 1, "merged").otherwise("closed"))
        .when(kind == "error", "created")
        .alias("action"),
        F.when(kind == "purchase", tenth).alias("pr_id"),
        F.when(kind == "signup", tenth).alias("issue_id"),
        F.when(kind == "error", event_id).alias("comment_id"),
        F.to_date("ts").alias("event_date"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events nested as the feed delivers them, with damage.

    Every 50th event is there twice, the copy one second later, and every 97th
    lacks its actor's login.
    """
    flat = activity_events(spark, sf_dir)
    number = F.col("event_id").cast("bigint")
    copies = F.when(number % COPY_EVERY == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    each = flat.withColumn("copy", F.explode(copies))
    made = F.timestamp_add("SECOND", F.col("copy"), F.col("created_at"))
    payload = F.struct(
        F.col("action"),
        F.when(F.col("pr_id").isNotNull(), F.struct(F.col("pr_id").alias("id"))).alias("pull_request"),
        F.when(F.col("issue_id").isNotNull(), F.struct(F.col("issue_id").alias("id"))).alias("issue"),
        F.when(
            F.col("comment_id").isNotNull(),
            F.struct(
                F.col("comment_id").alias("id"),
                F.concat(F.lit("line one\n\"quoted\" "), F.col("comment_id")).alias("body"),
                F.struct(F.col("username").alias("login")).alias("user"),
            ),
        ).alias("comment"),
    )
    return each.select(
        F.col("event_id").alias("id"),
        "type",
        F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        "public",
        F.struct(
            F.col("user_id").alias("id"),
            F.when(number % DAMAGE_EVERY != 0, F.col("username")).alias("login"),
            F.concat(F.lit("users/"), F.col("username")).alias("url"),
        ).alias("actor"),
        F.struct(
            F.col("repo_id").alias("id"),
            F.col("repo").alias("name"),
            F.concat(F.lit("repos/"), F.col("repo")).alias("url"),
        ).alias("repo"),
        F.when(
            F.col("org_id").isNotNull(),
            F.struct(F.col("org_id").alias("id"), F.col("org_name").alias("login")),
        ).alias("org"),
        payload.alias("payload"),
        F.col("event_date"),
    )


def bronze_root(spark: SparkSession, sf_dir: str, late: bool = False, damaged: bool = False) -> str:
    """Folder with the raw events as hourly gzip JSON, written once per session.

    With ``late`` some events come with the next day's files instead of their
    own, and others with both. With ``damaged`` some lines end in the middle and
    some have no readable time.
    """
    return _write_bronze(spark, spark.conf.get("spark.app.id", "local"), sf_dir, late, damaged)


def query_root(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of a query's tables, the same in a session, so that running it again replaces them."""
    return _new_root(spark, spark.conf.get("spark.app.id", "local"), sf_dir, name)


def new_root(spark: SparkSession, name: str) -> str:
    """A folder that nothing was written to yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@functools.lru_cache(maxsize=None)
def _new_root(spark: SparkSession, app_id: str, sf_dir: str, name: str) -> str:
    return new_root(spark, name)


@functools.lru_cache(maxsize=None)
def _write_bronze(spark: SparkSession, app_id: str, sf_dir: str, late: bool, damaged: bool) -> str:
    root = query_root(spark, sf_dir, "late" if late else "damaged" if damaged else "raw")
    deliver(raw_lines(spark, sf_dir, late, damaged), root)
    return root


def raw_lines(spark: SparkSession, sf_dir: str, late: bool = False, damaged: bool = False) -> DataFrame:
    """The raw events as lines, with the day and hour of the file that each comes in."""
    raw, number = raw_events(spark, sf_dir), F.col("id").cast("bigint")
    delays = F.array(F.lit(0))
    if late:
        delays = F.when(number % TWICE_EVERY == 0, F.array(F.lit(0), F.lit(1)))
        delays = delays.when(number % LATE_EVERY == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(0)))
    line = F.to_json(F.struct(*[c for c in raw.columns if c != "event_date"]))
    if damaged:
        untimed = F.regexp_replace(line, '"created_at":"[^"]*"', '"created_at":"no time"')
        line = F.when(number % CUT_EVERY == 0, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).when(
            number % UNTIMED_EVERY == 0, untimed
        ).otherwise(line)
    return raw.withColumn("delay", F.explode(delays)).select(
        F.date_add("event_date", F.col("delay")).cast("string").alias("day"),
        F.hour(F.to_timestamp("created_at")).alias("hour"),
        line.alias("line"),
    )


def deliver(lines: DataFrame, root: str) -> None:
    """Write lines to the hourly files that the feed would deliver."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_lines = lines.repartition(parts, "day", "hour").sortWithinPartitions("day", "hour")
    sorted_lines.mapInArrow(_hour_files(f"{root}/bronze"), "path string").count()


def _hour_files(folder: str):
    """Write the lines of each day and hour to the file the feed would deliver.

    The lines of an hour in a batch are written at once, packed lightly: at the highest
    level packing takes several times as long as all other steps together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = fs.FileSystem.from_uri(folder)
        opened, stream, file = None, None, None

        def close() -> None:
            if file is not None:
                file.close()
                stream.close()

        for batch in batches:
            keys = zip(batch.column("day").to_pylist(), batch.column("hour").to_pylist(), strict=True)
            lines, start = batch.column("line").cast(pa.binary()), 0
            for (day, hour), same in itertools.groupby(keys):
                n = sum(1 for _ in same)
                if (day, hour) != opened:
                    close()
                    system.create_dir(f"{inside}/{day}", recursive=True)
                    opened, stream = (day, hour), system.open_output_stream(f"{inside}/{day}/{day}-{hour}.json.gz", compression=None)
                    file = gzip.GzipFile(fileobj=stream, mode="wb", compresslevel=1, mtime=0)
                file.write(b"\n".join([*lines.slice(start, n).to_pylist(), b""]))
                start += n
        close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([], pa.string())})

    return run
