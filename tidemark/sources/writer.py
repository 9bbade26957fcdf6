"""Writing tables partitioned by day."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cleaning import day_parts
from tidemark.params import DateLike, parse_date
from tidemark.schemas import DAY_PARTS
from tidemark.sources.lake import table_path


def write_partitioned(
    df: DataFrame,
    root: str,
    layer: str,
    table: str,
    date_col: str = "event_date",
    partition_by: Sequence[str] = (),
    gather: str | None = "day",
    register: bool = False,
    replace_all: bool = False,
    cluster_by: Sequence[str] = (),
    spread_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    row_group_bytes: int | None = None,
) -> str:
    """Write rows into day partitions, replacing the partitions they fall into.

    Writing the same day again leaves the same rows. ``partition_by`` adds
    partition columns below the day. ``gather`` brings the rows of a day
    together, so that a day becomes few files:

    - ``"day"`` gives each day to one task, for results of a few rows per day;
    - ``"size"`` lets adaptive execution go by size: it joins small days in
      one task and splits a day that is too large for one;
    - ``None`` leaves rows where they are, for rows that are all of one day.

    With ``cluster_by`` rows are dealt by ranges of the partition and these columns instead,
    and sorted by them within files, so that the statistics of row groups (of
    ``row_group_bytes``, if given) rule most of them out for a filter on these columns. A
    hash of the whole row is the last key of the ranges, so that rows of one key that are
    too many for one task go to several; where some columns tell rows apart, name them as
    ``spread_by``, and the pass that finds the ranges reads no others. ``sort_by`` only sorts within files, however rows
    are gathered. With ``replace_all`` the whole table is replaced.
    """
    out = df.withColumns(day_parts(date_col))
    keys = [*DAY_PARTS, *partition_by]
    columns = [F.col(k) for k in keys]
    if cluster_by:
        order = [*columns, *[F.col(c) for c in cluster_by]]
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartitionByRange(parts, *order, F.xxhash64(*(spread_by or df.columns))).sortWithinPartitions(*order)
    elif gather == "day":
        out = out.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
    elif gather == "size":
        out = out.hint("rebalance", *columns)
    elif gather is not None:
        raise ValueError(f"unknown way to gather rows: {gather!r}")
    if sort_by and not cluster_by:
        out = out.sortWithinPartitions(*keys, *sort_by)
    path = table_path(root, layer, table)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "static" if replace_all else "dynamic")
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.partitionBy(*keys).parquet(path)
    if register:
        register_table(df.sparkSession, root, layer, table)
    return path


def register_table(
    spark: SparkSession,
    root: str,
    layer: str,
    table: str,
    partitions: Iterable[Mapping[str, object]] | None = None,
) -> str:
    """Make a stored table known to the session catalog as ``layer.table``.

    A table that is known already takes up the given partitions, those that
    were written; without them, and for a new table, all folders are listed.
    """
    name = f"`{layer}`.`{table}`"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{layer}`")
    known = spark.catalog.tableExists(name)
    if not known:
        spark.catalog.createTable(name, path=table_path(root, layer, table), source="parquet")
    if known and partitions is not None:
        for keys in partitions:
            spec = ", ".join(f"{k} = '{v}'" for k, v in keys.items())
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({spec})")
    else:
        spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return name


def day_partition(date: DateLike, **more: object) -> dict[str, object]:
    """The partition of a day, for ``register_table``."""
    day = parse_date(date)
    return {name: getattr(day, name) for name in DAY_PARTS} | more
