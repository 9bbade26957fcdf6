"""A wide table that grows columns: each day has one per label of that day, and a read has them all."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cleaning import select_columns
from tidemark.operators.trends import labels_of_day, widen
from tidemark.params import DateLike
from tidemark.schemas import DAY_PARTS, GOLD_LAYER, GOLD_TABLES
from tidemark.sources.lake import on_partition, read_table, table_path
from tidemark.sources.writer import write_partitioned

KEYS = ("event_date", "hour")


def wide_name(table: str) -> str:
    return f"{table}_wide"


def write_wide(spark: SparkSession, root: str, table: str, date: DateLike) -> list[str]:
    """Store the wide view of a date of a tidy summary, with the labels of that date as columns.

    Other dates keep their columns. Labels that differ in case only, or read like one
    of the key or partition columns, cannot be columns beside each other: a day that has
    such is refused, and the tidy table serves it.
    """
    label, value = GOLD_TABLES[table].pivot
    tidy = read_table(spark, root, table, date)
    names = labels_of_day(tidy, label)
    taken = Counter(name.lower() for name in (*names, *KEYS, *DAY_PARTS))
    if clash := [name for name in names if taken[name.lower()] > 1]:
        raise ValueError(f"labels that cannot be columns: {', '.join(clash)}")
    write_partitioned(widen(tidy, label, value, names), root, GOLD_LAYER, wide_name(table), gather="size")
    return names


def read_evolving(
    spark: SparkSession, root: str, table: str, date: DateLike | None = None, names: Sequence[str] | None = None
) -> DataFrame:
    """The stored wide table with the columns of all its days, null where a day has no such label.

    With a ``date`` only rows of that date, with the same columns; with ``names`` exactly
    these columns after the keys, null where no day has them. The schemas of all files are
    merged, in tasks. A table that is not there is an error unless ``names`` are given.
    """
    base = table_path(root, GOLD_LAYER, wide_name(table))
    try:
        found = spark.read.option("mergeSchema", True).parquet(base)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND" or names is None:
            raise
        hour = dict(part.rsplit(" ", 1) for part in GOLD_TABLES[table].ddl.split(", "))["hour"]
        found = spark.createDataFrame([], f"event_date date, hour {hour}, year int, month int, day int")
    if date is not None:
        found = found.where(on_partition(date))
    found = found.drop(*DAY_PARTS)
    if names is None:
        return found
    absent = [name for name in names if name not in found.columns]
    for name in absent:
        found = found.withColumn(name, F.lit(None).cast("bigint"))
    return select_columns(found, [*KEYS, *names])
