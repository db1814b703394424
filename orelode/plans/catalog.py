"""All queries of the core, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orelode.plans import data_problems, forensics, repository_queries, store_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [data_problems, forensics, store_queries, repository_queries]


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
