"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from criterium.plans.derive import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` is its oracle, over driver and derived tables in braces."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = oracle(sql)
        return f

    return add


from criterium.plans import answers, batched, composite, generated, linked, panel, reconciled, recorded, sampled, series, texts, training  # noqa: E402, F401
