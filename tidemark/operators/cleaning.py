"""From raw nested events to the flat event table, and row-level helpers."""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.activity import repo_part
from tidemark.functions.time import utc_wall_clock
from tidemark.params import DateLike, parse_date
from tidemark.schemas import DAY_PARTS, EVENT_COLUMNS, EXTRA_COLUMNS, REQUIRED_PATHS


def is_complete(cols: Iterable[str] = REQUIRED_PATHS) -> Column:
    """Whether a row has a value in every column; the names may be nested paths."""
    return functools.reduce(operator.and_, [F.col(name).isNotNull() for name in cols])


def drop_incomplete(df: DataFrame, cols: Iterable[str] = REQUIRED_PATHS) -> DataFrame:
    """Drop rows that lack any of the required members."""
    return df.where(is_complete(cols))


def dedupe(
    df: DataFrame,
    keys: Sequence[str] = ("id",),
    order: Sequence[str] = ("created_at", "source_file"),
    complete: Iterable[str] = (),
) -> DataFrame:
    """Keep one row per key: the earliest, then the first by file, then by a hash of its content.

    The hash makes the survivor the same in every run, and the sort key stays
    narrow however wide the rows are; project to the columns wanted before.
    Spark keeps only the first row per key within each input partition before
    it shuffles, so a key that a third of all rows share costs one row per
    task. A row with a value in all of the columns ``complete`` wins first.
    """
    ranking = [F.col(c).asc_nulls_last() for c in order]
    if rest := [c for c in df.columns if c not in (*order, *keys)]:
        ranking.append(F.xxhash64(*rest).asc())
    if complete := list(complete):
        ranking.insert(0, is_complete(complete).desc())
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*ranking))
    return df.withColumn("_copy", first).where(F.col("_copy") == 1).drop("_copy")


def day_parts(ts: Column | str = "created_at") -> dict[str, Column]:
    """The year, month and day of a timestamp or date."""
    return dict(zip(DAY_PARTS, (F.year(ts), F.month(ts), F.day(ts)), strict=True))


def flatten(df: DataFrame, extra: Sequence[str] = (), marks: Mapping[str, Column] | None = None) -> DataFrame:
    """Raw events as flat rows; ``extra`` adds optional payload members, ``marks`` further columns."""
    created = utc_wall_clock("created_at")
    computed = {
        "created_at": created,
        "repo_owner": repo_part("repo.name", 0),
        "repo_name": repo_part("repo.name", 1),
        **day_parts(created),
    }
    columns = [
        (F.col(path) if path else computed[name]).alias(name)
        for name, _, path in EVENT_COLUMNS
        if name not in DAY_PARTS
    ]
    columns += [F.col(EXTRA_COLUMNS[name][1]).alias(name) for name in extra]
    columns += [computed[name].alias(name) for name in DAY_PARTS]
    columns += [mark.alias(name) for name, mark in (marks or {}).items()]
    return df.select(*columns)


def late_events(events: DataFrame, ingest: str) -> DataFrame:
    """Events that came with another day's files only, each once.

    ``ingest`` has the day of the file an event came in. The files of one day
    hold an event once, so only events from another day's files can be there
    again. These few are looked up by id among the day's own, of which
    nothing but the id is read.
    """
    day, key = F.make_date(*DAY_PARTS), [*DAY_PARTS, "event_id"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(ingest))
    others = events.where(F.col(ingest) != day).withColumn("_copy", first).where(F.col("_copy") == 1).drop("_copy")
    own = events.where(F.col(ingest) == day).select(*key)
    return others.join(own, key, "left_anti").select(*events.columns)


def events_once(events: DataFrame, ingest: str) -> DataFrame:
    """The event table with each event once per day, however often it was delivered.

    The day's own events are not moved.
    """
    own = events.where(F.col(ingest) == F.make_date(*DAY_PARTS))
    return own.unionByName(late_events(events, ingest))


def on_day(df: DataFrame, date: DateLike, ts_col: str = "created_at") -> DataFrame:
    """Rows of one calendar day.

    The event table's partition columns are the day of its timestamp: they
    prune whole folders, and the timestamp need not be read. Elsewhere a
    half-open range on the timestamp reaches the Parquet row groups.
    """
    day = parse_date(date)
    if ts_col == "created_at" and set(DAY_PARTS) <= set(df.columns):
        return df.where(functools.reduce(operator.and_, [F.col(name) == getattr(day, name) for name in DAY_PARTS]))
    ts = F.col(ts_col)
    kind = dict(df.dtypes)[ts_col]
    start, end = (F.lit(str(d)).cast(kind) for d in (day, day + dt.timedelta(days=1)))
    return df.where((ts >= start) & (ts < end))


def quoted(name: str) -> str:
    """A column name that may hold dots or back-quotes, as a reference to it."""
    return "`" + name.replace("`", "``") + "`"


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Project columns by their literal names, dots and all."""
    return df.select(*[F.col(quoted(name)) for name in names])


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Refuse a result that lacks a needed column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def scoped(df: DataFrame, date: DateLike | None) -> DataFrame:
    """Events of one day or of all days, with ``event_date`` as a column.

    Where the event table's partition columns are there, the day comes from
    them: a count by day then reads no timestamp at all.
    """
    if date is not None:
        df = on_day(df, date)
    if "event_date" in df.columns:
        return df
    if set(DAY_PARTS) <= set(df.columns):
        return df.withColumn("event_date", F.make_date(*DAY_PARTS))
    return df.withColumn("event_date", F.to_date(F.col("created_at")))


def day_of(date: DateLike) -> Column:
    return F.lit(parse_date(date))
