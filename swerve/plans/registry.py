"""All registered queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its key, with the SQL that gives the same rows where there is one."""

    def add(f: Query) -> Query:
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


for _name in ("scans", "columns", "joining", "aggregating", "ordering", "tracking", "turning", "linking", "estimating", "checking", "ingesting"):
    importlib.import_module(f"swerve.plans.{_name}")
