"""Registry of runnable queries: name -> (Spark query, SQL for the side-by-side check)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaylake.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
MODULES = ("rewards", "validation", "reports", "novelty", "bandit", "texts", "storage")


def query(name: str, oracle: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under a name, with its SQL where SQL can say it."""

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return wrap


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"assaylake.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
