"""Raw hourly event files: gzip JSON, one event per line.

They lie at ``{root}/bronze/{date}/{date}-{hour}.json.gz``; the hour is not
padded. A gzip file cannot be split, so one file is one read task; the
deduplication that follows spreads the rows again.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.params import HOURS, DateLike, parse_date
from tidemark.schemas import bronze_schema


def bronze_day(root: str, date: DateLike) -> str:
    return f"{root}/bronze/{parse_date(date)}"


def hour_paths(root: str, date: DateLike, hours: Iterable[int] = HOURS) -> list[str]:
    """Paths of a day's hourly files."""
    day = parse_date(date)
    return [f"{bronze_day(root, day)}/{day}-{hour}.json.gz" for hour in hours]


def read_bronze(
    spark: SparkSession,
    root: str,
    date: DateLike | None = None,
    hours: Iterable[int] | None = None,
    extra: Sequence[str] | None = None,
    paths: Sequence[str] | None = None,
) -> DataFrame:
    """Raw events of some hours, of a day, or of every day under ``root``; or those of ``paths``.

    The fixed schema saves the pass that inference would take. With ``extra`` it
    has only the members that the event table and these optional columns need,
    and the parser skips all others; without, it has all that are known. Lines
    that are not JSON become rows of nulls, which the completeness check
    removes later.
    """
    reader = (
        spark.read.schema(bronze_schema(extra))
        .option("mode", "PERMISSIVE")
        .option("multiLine", False)
        .option("timeZone", "UTC")
    )
    if paths is not None:
        raw = reader.json(list(paths))
    elif date is None:
        if hours is not None:
            raise ValueError("hours need a date")
        raw = reader.option("recursiveFileLookup", True).json(f"{root}/bronze")
    elif hours is None:
        raw = reader.json(bronze_day(root, date))
    else:
        # One pattern for all hours: an hour without a file is no error.
        names = ",".join(path.rpartition("/")[2] for path in hour_paths(root, date, hours))
        raw = reader.json(f"{bronze_day(root, date)}/{{{names}}}")
    return raw.withColumn("source_file", F.col("_metadata.file_path"))


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Raw lines as they are, as ``line``, with the file each is from; blank ones are none."""
    lines = spark.read.option("recursiveFileLookup", True).text(list(paths)).withColumnRenamed("value", "line")
    return lines.where(F.trim("line") != "").withColumn("source_file", F.col("_metadata.file_path"))


def infer_bronze(spark: SparkSession, path: str) -> DataFrame:
    """Raw events with the schema found in the data, for looking at new feeds.

    This reads the files one more time, and a member that no event carries is
    absent from the result.
    """
    raw = spark.read.option("multiLine", False).option("recursiveFileLookup", True).json(path)
    return raw.withColumn("source_file", F.col("_metadata.file_path"))
