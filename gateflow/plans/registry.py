"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Views, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of :class:`Views` as a query; ``sql`` is its equivalent over ``views``."""

    def add(f: Callable[[Views], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _SQL[name] = with_views(sql, *views)
        return f

    return add


def _load() -> None:
    from . import event_queries, fleet_queries, gate_queries, scalar_queries, stream_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["seal_verdict_per_pass"](spark, sf_dir)
