"""All queries of the library and the DuckDB SQL that states each one's result."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame with its SQL."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    import loomspark.plans

    for m in pkgutil.iter_modules(loomspark.plans.__path__):
        importlib.import_module(f"loomspark.plans.{m.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
