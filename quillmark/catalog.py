"""Registered queries over the driver tables and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.plans import access_queries, catalog_queries
from quillmark.plans.fixtures import Tables, with_tables

_MODULES = (access_queries, catalog_queries)


def _query(run: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(run) for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    views = {k: v for m in _MODULES for k, v in getattr(m, "VIEWS", {}).items()}
    return {name: with_tables(sql, views) for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
