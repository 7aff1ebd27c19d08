"""Queries with the SQL that has the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shutterlake.sources.tables import BRIDGE, PHOTOS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _view(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM {table}"


EFFECTIVE = "CASE WHEN user_selection <> 'UNRATED' THEN user_selection ELSE ai_recommendation END"
_CATALOG = f"photos AS (SELECT *, {EFFECTIVE} AS eff FROM ({_view(PHOTOS, 'orders')})), bridge AS ({_view(BRIDGE, 'lineitem')})"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; its SQL may read photos (with eff) and bridge, and give further CTEs after `WITH CATALOG`."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("CATALOG", _CATALOG)
        return f

    return add
