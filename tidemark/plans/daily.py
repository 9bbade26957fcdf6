"""Whole runs: raw events to the event table to the daily summaries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark import operators as op
from tidemark.functions import utc_wall_clock
from tidemark.params import HOURS, DateLike, hour_window, parse_date
from tidemark.schemas import (
    COUNTS_LAYER,
    COUNTS_SCHEMA,
    COUNTS_TABLE,
    DAY_PARTS,
    GOLD_LAYER,
    GOLD_TABLES,
    HAS_PAYLOAD,
    INGEST_COLUMN,
    REJECTED_SCHEMA,
    REJECTED_TABLE,
    REQUIRED_COLUMNS,
    REQUIRED_PATHS,
    SILVER_LAYER,
    SILVER_TABLE,
    bronze_schema,
    silver_schema,
)
from tidemark.sources import (
    Record,
    clear_partition,
    day_partition,
    delivered,
    hour_of_file,
    raw_files,
    read_bronze,
    read_days,
    read_lines,
    read_records,
    register_table,
    scan_paths,
    silver_exists,
    write_partitioned,
    write_records,
)


WRITES_AT_ONCE = 9


def _flat(raw: DataFrame, extra: Sequence[str] = (), ingest: Column | None = None) -> DataFrame:
    """Raw events projected to the columns wanted, before anything is sorted or moved."""
    marks = {HAS_PAYLOAD: F.when(F.col("payload").isNotNull(), True)}
    return op.flatten(raw, extra, marks if ingest is None else marks | {INGEST_COLUMN: ingest})


def _one_copy(flat: DataFrame, prefer_complete: bool) -> DataFrame:
    keys = ["event_id", *[c for c in (INGEST_COLUMN,) if c in flat.columns]]
    return op.dedupe(flat, keys, complete=REQUIRED_COLUMNS if prefer_complete else ())


def silver_frame(raw: DataFrame, extra: Sequence[str] = (), prefer_complete: bool = False) -> DataFrame:
    """Raw events flattened, deduplicated and checked."""
    return op.drop_incomplete(_one_copy(_flat(raw, extra), prefer_complete), REQUIRED_COLUMNS).drop(HAS_PAYLOAD)


def _file_day() -> Column:
    """Day of the folder a raw file lies in."""
    return F.try_to_date(F.regexp_extract("source_file", r"(\d{4}-\d{2}-\d{2})/[^/]+$", 1))


@dataclass(frozen=True)
class Written:
    """What became of the lines of some raw files."""

    counts: dict[str, int]
    days: Mapping[dt.date, frozenset[dt.date]]
    """The days that the events of each day's files are dated in."""
    with_rejects: Sequence[str]
    """The files in which some line was set aside."""


def _write_silver(
    spark: SparkSession,
    root: str,
    date: DateLike | None,
    hours: Iterable[int] | None,
    extra: Sequence[str],
    prefer_complete: bool,
    place: str,
    paths: Sequence[str] | None = None,
) -> Written:
    raw = read_bronze(spark, root, date if paths is None else None, hours if paths is None else None, extra, paths)
    flat = _flat(raw, extra, _file_day() if date is None else F.lit(parse_date(date)))
    anything = F.coalesce(*[F.col(c).cast("string") for c in ("event_id", "type", "created_at", "username", "repo", HAS_PAYLOAD)])
    usable = op.is_complete((*REQUIRED_COLUMNS, "created_at"))
    lines, kept, written = Observation(), Observation(), Observation()
    flat = flat.observe(
        lines,
        F.count(F.lit(1)).alias("lines"),
        F.count_if(anything.isNull()).alias("malformed"),
        F.count("event_id").alias("with_id"),
        F.collect_set(F.when(~usable, F.col("source_file"))).alias("with_rejects"),  # at most the names of the files
    )
    single = _one_copy(flat.where(F.col("event_id").isNotNull()), prefer_complete).observe(
        kept,
        F.count(F.lit(1)).alias("single"),
        F.count_if(op.is_complete(REQUIRED_COLUMNS)).alias("complete"),
    )
    events = op.drop_incomplete(single, (*REQUIRED_COLUMNS, "created_at")).drop(HAS_PAYLOAD)
    events = events.observe(
        written,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.to_date("created_at") != F.col(INGEST_COLUMN)).alias("outside_their_day"),
        F.collect_set(F.struct(INGEST_COLUMN, F.to_date("created_at").alias("day"))).alias("days"),  # a few per day of files
    )
    gather = "size" if date is None else None
    write_partitioned(events, place, SILVER_LAYER, SILVER_TABLE, "created_at", [INGEST_COLUMN], gather)
    a, b, c = lines.get, kept.get, written.get
    days: dict[dt.date, set[dt.date]] = {}
    for ingest, day in c["days"]:
        days.setdefault(ingest, set()).add(day)
    counts = {
        "lines": a["lines"],
        "malformed": a["malformed"],
        "copies": a["with_id"] - b["single"],
        "incomplete": a["lines"] - a["malformed"] - a["with_id"] + b["single"] - b["complete"],
        "undated": b["complete"] - c["rows"],
        "rows": c["rows"],
        "outside_their_day": c["outside_their_day"],
    }
    return Written(counts, {day: frozenset(found) for day, found in days.items()}, sorted(a["with_rejects"]))


def build_silver(
    spark: SparkSession,
    root: str,
    date: DateLike | None = None,
    hours: Iterable[int] | None = None,
    extra: Sequence[str] = (),
    prefer_complete: bool = False,
    register: bool = False,
    lake: str | None = None,
) -> dict[str, int]:
    """Build the event table from the raw files of one day or of all days.

    ``lake`` is where the tables go, if not to the root of the raw files.

    An event may be dated outside the day of the file it came in. Below the
    event's own day the table is therefore partitioned by the day of the file:
    building a day again replaces what its files gave before, and nothing that
    a neighbouring day's files gave. Copies of an event are looked for among
    the files of one day, so building all days at once gives the same table as
    building them one by one.

    Returns how many lines were read and what became of them: ``malformed``
    ones are no events at all, ``copies`` have the id of another event of the
    day's files, ``incomplete`` ones lack a required member, ``undated`` ones a
    readable time. The ``rows`` were written, ``outside_their_day`` of them
    under another day than that of their file.
    """
    place = lake or root
    written = _write_silver(spark, root, date, hours, extra, prefer_complete, place)
    if register:
        parts = None if date is None else _silver_partitions(written.days)
        register_table(spark, place, SILVER_LAYER, SILVER_TABLE, parts)
    return written.counts


def _silver_partitions(days: Mapping[dt.date, Iterable[dt.date]]) -> list[dict[str, object]]:
    return [day_partition(day, **{INGEST_COLUMN: ingest}) for ingest, found in sorted(days.items()) for day in sorted(found)]


def rejected_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The lines of raw files that are no usable events, with the file and the reason.

    ``malformed`` lines are not whole JSON, or hold nothing of an event, ``incomplete`` ones
    lack a required member, ``undated`` ones a readable time, in this order. Each line is
    judged for itself: it may be a copy of an event that is in order and in the event
    table. (The counts of a run call a line malformed only if nothing in it can be read;
    one that ends in the middle counts as incomplete there.)
    """
    lines = read_lines(spark, paths)
    event = F.from_json("line", bronze_schema(()), {"mode": "PERMISSIVE", "timeZone": "UTC"})
    lines = lines.withColumn("event", event)
    member = lambda path: F.col(f"event.{path}")
    nothing = F.coalesce(*[member(path).cast("string") for path in REQUIRED_PATHS if path != "payload"], member("created_at").cast("string"))
    nothing = nothing.isNull() & member("payload").isNull()
    whole = op.is_complete([f"event.{path}" for path in REQUIRED_PATHS])
    dated = utc_wall_clock("event.created_at").isNotNull()
    broken = nothing | F.try_parse_json("line").isNull()
    reason = F.when(whole & dated, None).when(broken, "malformed").when(~whole, "incomplete").otherwise("undated")
    found = lines.withColumn("reason", reason).where(F.col("reason").isNotNull())
    file = F.regexp_extract("source_file", "[^/]+$", 0)
    return found.select("line", file.alias("file"), "reason", _file_day().alias(INGEST_COLUMN))


def read_rejected(spark: SparkSession, root: str, dates: Iterable[DateLike] | None = None) -> DataFrame:
    """The lines set aside, of some days of files or of all."""
    days = None if dates is None else sorted({parse_date(d) for d in dates})
    return read_days(spark, root, SILVER_LAYER, REJECTED_TABLE, days, REJECTED_SCHEMA)


def events_for_summaries(
    spark: SparkSession, root: str, days: Sequence[dt.date] | None = None
) -> DataFrame:
    """The event table, or some days of it, with each event once per day."""
    return op.events_once(_delivered(spark, root, days), INGEST_COLUMN).drop(INGEST_COLUMN)


def _delivered(spark: SparkSession, root: str, days: Sequence[dt.date] | None) -> DataFrame:
    return read_days(spark, root, SILVER_LAYER, SILVER_TABLE, days, silver_schema())


def changed_events(
    spark: SparkSession, root: str, days: Sequence[dt.date] | None, own_days: Sequence[dt.date] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The events of days of which the counts may have changed: own ones of ``own_days`` (of all by default), and late ones.

    The late part of a day is small. Its events are held against the ids of the day's own
    ones, of which nothing else is read unless the day is among ``own_days``.
    """
    found, day = _delivered(spark, root, days), F.make_date(*DAY_PARTS)
    of_own = found.where(F.col(INGEST_COLUMN) == day)
    if own_days is not None:
        of_own = _delivered(spark, root, sorted(set(own_days))).where(F.col(INGEST_COLUMN) == day)
    late = op.late_events(found, INGEST_COLUMN)
    return tuple(df.withColumn("delivered", F.lit(part)) for df, part in ((of_own, op.OWN), (late, op.LATE)))


def _refresh_counts(spark: SparkSession, root: str, days: Sequence[dt.date] | None, own_days: Sequence[dt.date] | None) -> None:
    """Count anew the parts of days that may have changed.

    The folders say whether any event came with another day's files; where none did, the
    ids of the days' own events are not read.
    """
    events, late = changed_events(spark, root, days, own_days)
    with_others = not _delivered(spark, root, days).where(F.col(INGEST_COLUMN) != F.make_date(*DAY_PARTS)).isEmpty()
    if with_others:
        late = late.persist()
    try:
        if with_others and not late.isEmpty():
            events = events.unionByName(late)
        counts = op.count_parts(events)
        if days is not None:
            # A row that counts nothing per day and part, so that each partition is replaced.
            # (A day's kinds share a file, sorted by kind, as most days are small.)
            refreshed = [(d, part) for d in days for part in (op.OWN, op.LATE) if part == op.LATE or own_days is None or d in own_days]
            none = spark.createDataFrame(refreshed, "event_date date, delivered string")
            none = none.select("*", F.lit(0).cast("bigint").alias("n"), F.lit(op.KINDS[0]).alias("kind"))
            counts = counts.unionByName(none, allowMissingColumns=True)
        write_partitioned(
            counts.drop(*DAY_PARTS), root, COUNTS_LAYER, COUNTS_TABLE, partition_by=["delivered"], gather="size", sort_by=["kind"], replace_all=days is None
        )
    finally:
        if with_others:
            late.unpersist()


def read_counts(spark: SparkSession, root: str, days: Sequence[dt.date] | None = None) -> DataFrame:
    """The stored counts that summaries are rolled up from."""
    found = read_days(spark, root, COUNTS_LAYER, COUNTS_TABLE, days, COUNTS_SCHEMA)
    return found.withColumn("event_date", F.make_date(*DAY_PARTS))


def build_gold(
    spark: SparkSession,
    root: str,
    date: DateLike | Sequence[DateLike] | None = None,
    register: bool = False,
    changed: Sequence[dt.date] | None = None,
) -> list[str]:
    """Build and store the nine summaries of one day, of several days or of all days.

    The events are counted first; the counts are stored and the summaries rolled up from
    them. ``changed`` names the days whose own files were built anew, if that is known:
    of all others only late events are counted, and the stored counts serve for the rest.
    A day that is asked for alone gets an overview of zeros if it has no event, and
    loses the rows of the other summaries. Without an event table there is nothing to
    summarise, which is an error.
    """
    if not silver_exists(spark, root):
        raise FileNotFoundError(f"no event table under {root}")
    if date is None:
        days = None
    else:
        days = sorted({parse_date(d) for d in ([date] if isinstance(date, str | dt.date) else date)})
    one = days[0] if days and len(days) == 1 else None
    gather = "day" if one is None else "size"
    _refresh_counts(spark, root, days, changed)
    counts = read_counts(spark, root, days)
    frames = op.roll_up(counts, one)

    def write(name: str) -> None:
        write_partitioned(frames[name], root, GOLD_LAYER, name, gather=gather, replace_all=days is None)

    with ThreadPoolExecutor(WRITES_AT_ONCE) as pool:  # small jobs, mostly waiting for each other's last tasks
        list(pool.map(inheritable_thread_target(spark)(write), frames))
    for name in frames if register else ():
        register_table(spark, root, GOLD_LAYER, name, None if days is None else map(day_partition, days))
    if days is not None:
        with_events = counts.where((F.col("kind") == "types") & (F.col("n") > 0)).select("event_date").distinct()
        for day in set(days) - {row[0] for row in with_events.collect()}:  # a row per day asked for
            for name, table in GOLD_TABLES.items():
                if not (one and name == "overview_table"):
                    clear_partition(spark, root, GOLD_LAYER, name, table.schema, day)
    return list(GOLD_TABLES)


def _build(
    spark: SparkSession,
    root: str,
    place: str,
    there: Mapping[dt.date, Mapping[str, tuple[int, int]]],
    todo: Mapping[dt.date, Mapping[str, tuple[int, int]]],
    records: Mapping[dt.date, Record],
    register: bool,
) -> dict[str, int]:
    """Build some days from the files given for each, in one scan, and all summaries they touch."""
    old = {day: records.get(day, Record()) for day in todo}
    before = {day: set(record.days) for day, record in old.items()}
    if broken := [day for day, record in old.items() if record.pending]:
        # Where a build broke off, the table itself says what it wrote.
        rows = delivered(spark, place).where(F.col(INGEST_COLUMN).isin(broken))
        for row in rows.select(INGEST_COLUMN, *DAY_PARTS).distinct().collect():  # a few per broken day
            before[row[0]].add(dt.date(*row[1:]))
    write_records(spark, place, {day: replace(record, files={}, pending=True) for day, record in old.items()})

    one = next(iter(todo)) if len(todo) == 1 else None
    written = _write_silver(spark, root, one, None, (), False, place, scan_paths(root, todo, there))
    for day in todo:
        for gone in sorted(before[day] - written.days.get(day, frozenset())):
            clear_partition(spark, place, SILVER_LAYER, SILVER_TABLE, silver_schema(), gone, **{INGEST_COLUMN: day})
    named: dict[dt.date, list[str]] = {}
    for path in written.with_rejects:
        *_, day, name = path.split("/")
        named.setdefault(parse_date(day), []).append(name)

    def set_aside() -> None:
        if named:
            rejects = rejected_lines(spark, scan_paths(root, named, there))
            write_partitioned(rejects, place, SILVER_LAYER, REJECTED_TABLE, INGEST_COLUMN, gather="size")
        for day in sorted(day for day, record in old.items() if record.rejected and day not in named):
            clear_partition(spark, place, SILVER_LAYER, REJECTED_TABLE, REJECTED_SCHEMA, day)

    if register:
        register_table(spark, place, SILVER_LAYER, SILVER_TABLE, _silver_partitions(written.days))

    touched = set(todo).union(*before.values(), *written.days.values())
    with ThreadPoolExecutor(1) as beside:  # neither reads what the other writes
        aside = beside.submit(inheritable_thread_target(spark)(set_aside))
        build_gold(spark, place, sorted(touched), register=register, changed=sorted(todo))
        aside.result()
    done = {day: Record(files, written.days.get(day, frozenset()), day in named) for day, files in todo.items()}
    write_records(spark, place, done)
    return written.counts


def run_days(
    spark: SparkSession,
    root: str,
    dates: Iterable[DateLike],
    hours: Iterable[int] = HOURS,
    force: bool = False,
    register: bool = False,
    lake: str | None = None,
    check_range: bool = False,
) -> list[dict[str, object]]:
    """Build the days whose raw files of these hours are not in the tables yet, in one scan.

    A record per day names the raw files that all tables hold, with length and time of
    change. A day is built if a file of the hours asked for is not in its record as it
    lies there now: it came late, or was replaced. Files that were built before are built
    along, as a day's files are deduplicated together. The record is pending during a
    build and written when everything else is, so a run that breaks off is done again. The
    summaries are built of each day that any of the files' events are dated in, or were
    before. A day without any raw file of these hours is an error, unless it was built
    before. ``check_range`` refuses days that can have no raw files.

    Returns a report per day; what became of the lines is in the report of a day that was
    built alone, otherwise, for all days together, under ``of_run``.
    """
    place = lake or root
    days = sorted({parse_date(d, check_range=check_range) for d in dates})
    wanted = set(hours)
    there, records = raw_files(spark, root, days), read_records(spark, place, days)
    todo = {}
    for day in days:
        files, have = there.get(day, {}), records.get(day, Record())
        asked = {n: v for n, v in files.items() if wanted == set(HOURS) or hour_of_file(n, day) in wanted}
        if not asked and not have.files:
            read_bronze(spark, root, day, sorted(wanted))  # which says what is missing
            raise FileNotFoundError(f"no raw files of {day}")
        if asked and (force or any(have.files.get(n) != v for n, v in asked.items())):
            todo[day] = {n: v for n, v in files.items() if n in asked or n in have.files}
    counts = _build(spark, root, place, there, todo, records, register) if todo else {}
    of_run = counts if len(todo) == 1 else {"of_run": counts}
    return [{"date": day, "built": True, **of_run} if day in todo else {"date": day, "built": False} for day in days]


def run_day(
    spark: SparkSession,
    root: str,
    date: DateLike,
    start: int = 0,
    duration: int = 24,
    force: bool = False,
    register: bool = False,
    check_range: bool = False,
    lake: str | None = None,
) -> dict[str, object]:
    """Build a day's hours from ``start`` on unless they are built already.

    ``check_range`` refuses days that can have no raw files.
    """
    return run_days(spark, root, [date], hour_window(start, duration), force, register, lake, check_range)[0]


def run_all(
    spark: SparkSession, root: str, register: bool = False, lake: str | None = None, force: bool = True, check_range: bool = False
) -> dict[str, int]:
    """Build every day that has raw files, in one go; without ``force`` only days with new files.

    Returns what became of the lines, nothing if there was nothing to build.
    """
    place = lake or root
    there, records = raw_files(spark, root), read_records(spark, place)
    for day in there:
        parse_date(day, check_range=check_range)
    todo = {day: files for day, files in there.items() if force or files != records.get(day, Record()).files}
    if not there:
        read_bronze(spark, root)  # which says what is missing
    return _build(spark, root, place, there, todo, records, register) if todo else {}
