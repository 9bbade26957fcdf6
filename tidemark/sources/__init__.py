"""Reading raw events and stored tables, and writing tables."""

from tidemark.sources.bronze import hour_paths, infer_bronze, read_bronze, read_lines
from tidemark.sources.evolving import read_evolving, write_wide
from tidemark.sources.functions import register_functions
from tidemark.sources.lake import (
    clear_partition,
    day_exists,
    day_path,
    delivered,
    read_days,
    read_silver,
    read_silver_on,
    read_table,
    read_wide,
    register_views,
    run_sql,
    silver_exists,
    table_path,
)
from tidemark.sources.manifest import (
    Record,
    built_hours,
    hour_of_file,
    raw_files,
    read_records,
    scan_paths,
    write_records,
)
from tidemark.sources.writer import day_partition, register_table, write_partitioned

__all__ = [
    "Record",
    "built_hours",
    "clear_partition",
    "day_exists",
    "day_partition",
    "day_path",
    "delivered",
    "hour_of_file",
    "hour_paths",
    "infer_bronze",
    "raw_files",
    "read_bronze",
    "read_days",
    "read_evolving",
    "read_lines",
    "read_records",
    "read_silver",
    "read_silver_on",
    "read_table",
    "read_wide",
    "register_functions",
    "register_table",
    "register_views",
    "run_sql",
    "scan_paths",
    "silver_exists",
    "table_path",
    "write_partitioned",
    "write_records",
    "write_wide",
]
