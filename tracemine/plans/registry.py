"""The queries over the reference's data model, with their SQL twins.

Each query applies an operator to tables that the adapters derive from the given ones; its SQL says the same for DuckDB. Arrays are shown as text.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemine.plans.adapters import view, with_adapters

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

MODULES = ("scalar_queries", "replay_queries", "mining_queries", "generation_queries", "selection_queries", "planning_queries", "scoring_queries", "callgraph_queries", "source_queries")


def query(sql: str | None = None, **inputs: str):
    """Registers a function of DataFrames, each made by its SQL over adapters, under the function's name."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(**{k: view(spark, sf_dir, v) for k, v in inputs.items()})
        if sql is not None:
            _SQL[f.__name__] = with_adapters(sql)
        return f

    return register


def shown(column):
    """An array as text."""
    return F.array_join(column, ",")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tracemine.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
