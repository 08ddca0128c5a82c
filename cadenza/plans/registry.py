"""Queries of the timeline, mix, settings and text operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "humanize"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that DuckDB checks it against."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


from . import note_queries  # noqa: E402,F401
from . import mix_queries, scalar_queries, source_queries, text_queries  # noqa: E402,F401
from . import range_queries  # noqa: E402,F401
