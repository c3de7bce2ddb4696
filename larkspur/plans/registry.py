"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Decorator: register a query under its function's name, with the SQL that must give the same rows."""

    def put(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return put


MODULES = ("search", "relational", "business", "textual", "curating", "changing", "matching", "reports", "records", "stores", "streams", "matchers", "remotes", "kept", "columns", "contents")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
