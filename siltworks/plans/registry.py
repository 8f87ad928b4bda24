"""Every query of the core library with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "issue_summary"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a query under its function's name; sql is what DuckDB must agree with."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return put


for _module in ("text_queries", "page_queries", "read_queries", "join_queries", "diff_queries", "telemetry_queries", "graph_queries", "array_queries", "log_queries", "code_queries", "review_queries", "small_queries", "record_queries", "crawl_queries", "seek_queries", "finding_queries"):
    importlib.import_module(f"siltworks.plans.{_module}")
