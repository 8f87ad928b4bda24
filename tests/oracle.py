"""Spark results against DuckDB on the same Parquet files."""

import re

import duckdb
import pandas as pd
from siltworks.session import TABLES


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return re.sub(r"\.0$", "", repr(round(value, 9)))
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))
