"""Comparing a query with its SQL counterpart."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


SAME = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(df, con, sql: str) -> int:
    """Fail unless both give the same columns, types and rows; return the row count."""
    con.execute(f"CREATE OR REPLACE TEMP VIEW own_answer AS {sql}")  # as a view, the way it is stored elsewhere
    found = con.execute("SELECT * FROM own_answer")
    columns = [c[0] for c in found.description]
    types = {c[0]: str(c[1]) for c in found.description}
    want = _rows(found.fetchall(), columns)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    assert sorted(df.columns) == sorted(columns), (sorted(df.columns), sorted(columns))
    for name, dtype in df.dtypes:
        assert SAME[dtype] == types[name], (name, dtype, types[name])
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
    return len(got)
