"""All registered queries of the survey-detection operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "det_match_metrics"

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL twin where there is one."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLE_SQL[key] = sql
        return function

    return add


# The modules register their queries when they are imported.
from fathomline.plans import detection, frames, geo, register, scoring, store, texts  # noqa: E402, F401
