"""Registry of named queries: one Spark callable and (when SQL can express it)
one DuckDB oracle statement per key.  ``__spark_entry__`` only wires this."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, reachable

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)  # lineage cuts go to the shared folder
            reachable(spark)
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that their keys are registered."""
    from . import (q_matches, q_features, q_roles, q_vectors, q_ordering,  # noqa: F401
                   q_evaluate, q_scoring, q_audit, q_live, q_sources, q_models)
