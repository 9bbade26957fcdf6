"""Reading stored tables at ``{root}/{layer}/{table}/year=/month=/day=``."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.params import DateLike, parse_date
from tidemark.schemas import (
    DAY_PARTS,
    GOLD_LAYER,
    GOLD_TABLES,
    INGEST_COLUMN,
    SILVER_LAYER,
    SILVER_TABLE,
    silver_schema,
)
from tidemark.sources.bronze import bronze_day

log = logging.getLogger(__name__)

FEW_DAYS = 100


def table_path(root: str, layer: str, table: str) -> str:
    return f"{root}/{layer}/{table}"


def day_path(root: str, layer: str, table: str, date: DateLike) -> str:
    day = parse_date(date)
    return f"{table_path(root, layer, table)}/year={day.year}/month={day.month}/day={day.day}"


def on_partition(date: DateLike) -> Column:
    day = parse_date(date)
    return (F.col("year") == day.year) & (F.col("month") == day.month) & (F.col("day") == day.day)


def read_days(spark: SparkSession, root: str, layer: str, table: str, days: Sequence[dt.date] | None, schema: str) -> DataFrame:
    """Some days of a stored table, or all of it.

    Few days are read from their own folders, so that only these are listed; for many
    the table is listed once and its folders are pruned.
    """
    if days is None:
        return _scan(spark, root, layer, table, None, schema)
    if not days:
        return spark.createDataFrame([], schema)
    some = F.make_date(*DAY_PARTS).isin(list(days))
    if len(days) > FEW_DAYS:
        return _scan(spark, root, layer, table, None, schema).where(some)
    base = table_path(root, layer, table)
    folders = [day_path(root, layer, table, day).removeprefix(f"{base}/") for day in days]
    pattern = f"{base}/{folders[0]}" if len(folders) == 1 else f"{base}/{{{','.join(folders)}}}"
    try:
        return spark.read.option("basePath", base).schema(schema).parquet(pattern).where(some)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _scan(
    spark: SparkSession, root: str, layer: str, table: str, date: DateLike | None, schema: str | None
) -> DataFrame:
    """Scan a stored table, or one day of it.

    A day is read from its own folder, so that only that folder is listed: a
    table of many years holds far more files than a driver wants to list for
    one day. The partition columns come from the folder names all the same. A
    table or day that is not there reads as empty where its schema is known.
    """
    base = table_path(root, layer, table)
    reader = spark.read.option("basePath", base)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        if date is None:
            return reader.parquet(base)
        return reader.parquet(day_path(root, layer, table, date)).where(on_partition(date))
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND" or schema is None:
            raise
        return spark.createDataFrame([], schema)


def read_silver(
    spark: SparkSession, root: str, date: DateLike | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """The event table, or one calendar day of it: an event as often as days' files delivered it."""
    return delivered(spark, root, date, extra).drop(INGEST_COLUMN)


def delivered(
    spark: SparkSession, root: str, date: DateLike | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """The event table with the day of the file that each event came in."""
    return _scan(spark, root, SILVER_LAYER, SILVER_TABLE, date, silver_schema(extra))


def read_silver_on(spark: SparkSession, root: str, days: DataFrame, date_col: str = "event_date") -> DataFrame:
    """The event table on the days of a small table, found while the query runs.

    The days are sent to all tasks (a row per day of the calendar at most) and, by the
    partition columns, decide which folders are read at all: the plan has them as a
    dynamic pruning filter of the scan.
    """
    parts = dict(zip(DAY_PARTS, (F.year(date_col), F.month(date_col), F.day(date_col)), strict=True))
    wanted = days.where(F.col(date_col).isNotNull()).select(*[part.alias(name) for name, part in parts.items()]).distinct()
    events = read_silver(spark, root)
    return events.join(F.broadcast(wanted), list(DAY_PARTS), "left_semi").select(*events.columns)


def silver_exists(spark: SparkSession, root: str) -> bool:
    """Whether an event table was ever written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path(root, SILVER_LAYER, SILVER_TABLE))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def clear_partition(spark: SparkSession, root: str, layer: str, table: str, schema: str, date: DateLike, **more: object) -> None:
    """Replace a partition's files by one without rows; dynamic overwriting leaves alone what gets no row."""
    folder = "/".join([day_path(root, layer, table, date), *(f"{k}={v}" for k, v in more.items())])
    parts = {*DAY_PARTS, *more}
    empty = spark.createDataFrame([], schema)
    empty.drop(*parts).coalesce(1).write.mode("overwrite").parquet(folder)


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    date: DateLike | None = None,
    order_by: Sequence[Column | str] | None = None,
    limit: int | None = None,
    date_col: str = "event_date",
    layer: str = GOLD_LAYER,
) -> DataFrame:
    """A stored table for one date or all dates, optionally sorted and limited.

    One date of a summary comes in the summary's own order where no other is given.
    """
    spec = GOLD_TABLES.get(table) if layer == GOLD_LAYER else None
    if (layer, table) == (SILVER_LAYER, SILVER_TABLE):
        found = read_silver(spark, root, date)
    else:
        found = _scan(spark, root, layer, table, date, spec.schema if spec else None)
    if date is not None:
        found = found.where(F.to_date(F.col(date_col)) == F.lit(parse_date(date)))
        if order_by is None and spec is not None and spec.order_by:
            order_by = spec.order_by
    if order_by is not None:
        found = found.orderBy(*order_by)
    return found if limit is None else found.limit(limit)


def read_wide(
    spark: SparkSession, root: str, table: str, date: DateLike | None = None, names: Sequence[str] | None = None
) -> DataFrame:
    """The wide view of a table that is stored tidy: one column per label.

    The labels of one date are found in its few rows. For all dates give the
    ``names`` that are wanted, as labels grow with the days.
    """
    from tidemark.operators.trends import labels_of_day, widen

    label, value = GOLD_TABLES[table].pivot
    tidy = read_table(spark, root, table, date)
    if names is None:
        if date is None:
            raise ValueError("a wide view needs a date or names")
        names = labels_of_day(tidy, label)
    return widen(tidy, label, value, names)


def day_exists(
    spark: SparkSession, root: str, date: DateLike, layer: str = GOLD_LAYER, table: str | None = None
) -> bool:
    """Whether a day has any file: raw events, or a stored table's partition.

    Only the day's folder is listed; no file is opened. Any error counts as no.
    """
    if layer == "bronze":
        folder = bronze_day(root, date)
    else:
        folder = day_path(root, layer, table, date)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        return not files.select("path").isEmpty()
    except Exception as err:  # a day that cannot be looked at is built anew
        log.info("no data found at %s: %s", folder, type(err).__name__)
        return False


def register_views(spark: SparkSession, root: str) -> list[str]:
    """Temporary views for the event table and every daily summary."""
    read_silver(spark, root).createOrReplaceTempView(SILVER_TABLE)
    for name in GOLD_TABLES:
        read_table(spark, root, name).createOrReplaceTempView(name)
    return [SILVER_TABLE, *GOLD_TABLES]


def run_sql(spark: SparkSession, query: str, root: str | None = None, **args) -> DataFrame:
    """Any SQL query over the lake, with its values passed as named parameters."""
    if root is not None:
        register_views(spark, root)
    return spark.sql(query, args=args or None)
