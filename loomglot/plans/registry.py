"""The registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalogs import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, *catalogs: str):
    """Register a query with its SQL over the named catalogs."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = (("WITH " + ", ".join(map(oracle, catalogs))) if catalogs else "") + sql
        return f

    return add
