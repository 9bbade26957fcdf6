"""Which raw files the tables hold: a record per day of raw files, and the listing it is held against.

A record at ``{root}/built/ingest_date=`` names the files of a day that all tables hold,
with length and time of change, and the days that their events are dated in. A run lists
the raw files first and reads those; a file that comes or changes later differs from the
record and is taken up by the next run.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.params import DateLike, parse_date
from tidemark.schemas import INGEST_COLUMN
from tidemark.sources.bronze import bronze_day

Version = tuple[int, int]
"""Length in bytes and time of change in microseconds."""


@dataclass(frozen=True)
class Record:
    """What the tables hold of a day of raw files.

    ``days`` are the days its events are dated in, ``rejected`` says whether lines were
    set aside. While a build is under way the record is ``pending`` and names no files.
    """

    files: Mapping[str, Version] = field(default_factory=dict)
    days: frozenset[dt.date] = frozenset()
    rejected: bool = False
    pending: bool = False


def _found(df: DataFrame) -> list:
    try:
        return df.collect()
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _days_pattern(days: Iterable[dt.date], prefix: str = "") -> str:
    """One pattern for folders of several days: those that are not there are no error."""
    return "{" + ",".join(f"{prefix}{day}" for day in sorted(days)) + "}"


def raw_files(spark: SparkSession, root: str, days: Iterable[DateLike] | None = None) -> dict[dt.date, dict[str, Version]]:
    """The raw files of some days or of all, by listing alone: a few dozen rows per day."""
    chosen = None if days is None else {parse_date(d) for d in days}
    if chosen is not None and not chosen:
        return {}
    base = f"{root}/bronze"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        listed = reader.load(base if chosen is None else f"{base}/{_days_pattern(chosen)}")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    listed = listed.select(
        F.try_to_date(F.element_at(F.split("path", "/"), -2)).alias("day"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "length",
        F.unix_micros("modificationTime").alias("modified"),
    )
    found: dict[dt.date, dict[str, Version]] = {}
    for row in _found(listed.where("day is not null")):
        found.setdefault(row["day"], {})[row["name"]] = (row["length"], row["modified"])
    return found


def hour_of_file(name: str, day: dt.date) -> int | None:
    """The hour that a raw file is named after."""
    match = re.fullmatch(rf"{day}-(\d{{1,2}})\.json\.gz", name)
    return int(match[1]) if match else None


def scan_paths(root: str, chosen: Mapping[dt.date, Iterable[str]], there: Mapping[dt.date, Iterable[str]]) -> list[str]:
    """Paths that read the chosen files: a day's folder, or a pattern where not all of its files are meant."""
    paths = []
    for day, names in sorted(chosen.items()):
        folder, names = bronze_day(root, day), sorted(names)
        whole = set(names) == set(there[day])
        paths.append(folder if whole else f"{folder}/{{{','.join(names)}}}" if len(names) > 1 else f"{folder}/{names[0]}")
    return paths


RECORD = "files array<struct<name:string,length:long,modified:long>>, days array<date>, rejected boolean, pending boolean"


def write_records(spark: SparkSession, root: str, records: Mapping[dt.date, Record]) -> None:
    """Replace the records of some days."""
    if not records:
        return
    rows = [
        ([(name, *version) for name, version in sorted(r.files.items())], sorted(r.days), r.rejected, r.pending, day)
        for day, r in sorted(records.items())
    ]
    made = spark.createDataFrame(rows, f"{RECORD}, {INGEST_COLUMN} date").coalesce(1)
    made = made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    made.partitionBy(INGEST_COLUMN).json(f"{root}/built")


def read_records(spark: SparkSession, root: str, days: Iterable[DateLike] | None = None) -> dict[dt.date, Record]:
    """The records of some days or of all; days without one are left out."""
    chosen = None if days is None else {parse_date(d) for d in days}
    if chosen is not None and not chosen:
        return {}
    base = f"{root}/built"
    reader = spark.read.schema(f"{RECORD}, {INGEST_COLUMN} date").option("basePath", base)
    try:
        stored = reader.json(base if chosen is None else f"{base}/{_days_pattern(chosen, f'{INGEST_COLUMN}=')}")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {
        row[INGEST_COLUMN]: Record(
            {f["name"]: (f["length"], f["modified"]) for f in row["files"] or ()},
            frozenset(row["days"] or ()),
            bool(row["rejected"]),
            bool(row["pending"]),
        )
        for row in _found(stored)
    }


def built_hours(spark: SparkSession, root: str, date: DateLike) -> set[int]:
    """The hours of a day whose raw files all tables hold."""
    day = parse_date(date)
    files = read_records(spark, root, [day]).get(day, Record()).files
    return {hour for name in files if (hour := hour_of_file(name, day)) is not None}
