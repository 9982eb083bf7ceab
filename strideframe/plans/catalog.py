"""The registry of queries: each entry is a Spark plan and, where SQL can say it, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Each module registers its queries; the order here is the order of the registry.
from strideframe.plans import cards, details, gaps, headings, journal, mapdata, measures, network, quests, reach, requests, spacing, spatial, targets, tracks  # noqa: E402, F401
