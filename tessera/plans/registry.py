"""Registry of named queries: a Spark builder and, where SQL can express it,
the equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

_MODULES = ["samples", "gui", "geometry", "assembly", "cache", "logs", "evaluation", "catalog", "streams",
            "training", "records"]


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"tessera.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"tessera.plans.{m}":
                raise


def shipped(fn: Builder) -> Builder:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.session import ship_package
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Builder]:
    """Registered builders; each first makes the package importable on the
    executors (Arrow and stream-state functions run there)."""
    load_all()
    return {k: shipped(v) for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
