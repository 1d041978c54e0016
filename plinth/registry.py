"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir); oracle is the equivalent DuckDB SQL."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def oracle_sql_of(name: str) -> str:
    """The SQL of a query registered before, for SQL that builds on it."""
    return _ORACLES[name]


def _load() -> None:
    import plinth.plans as plans

    for m in pkgutil.iter_modules(plans.__path__, "plinth.plans."):
        importlib.import_module(m.name)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
