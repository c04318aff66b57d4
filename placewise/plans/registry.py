"""Named queries: a Spark plan over the tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from placewise.sources.views import Tables, duckdb_sql

_MODULES = (
    "source_queries",
    "lookup_queries",
    "join_queries",
    "metric_queries",
    "evaluation_queries",
    "visit_queries",
    "compliance_queries",
    "text_queries",
    "candidate_queries",
    "calibration_queries",
    "fusion_queries",
    "place_queries",
    "causal_queries",
    "streaming_queries",
)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


_REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def load() -> dict[str, Query]:
    for module in _MODULES:
        importlib.import_module(f"placewise.plans.{module}")
    return _REGISTRY


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, sf_dir: q.build(Tables(spark, sf_dir))

    return {name: bind(q) for name, q in load().items()}


def oracle_statements() -> dict[str, str]:
    return {name: duckdb_sql(q.sql) for name, q in load().items() if q.sql}
