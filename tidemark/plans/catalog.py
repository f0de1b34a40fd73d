"""Registry of named queries (Spark) and their DuckDB oracle texts.

Each query is ``fn(spark, sf_dir) -> DataFrame`` built from the library's
operators over the fixture views of the driver tables.  Computed columns are
aliased identically on both sides; floats are rounded to 4 dp (2 dp for money)
on both sides, counts are BIGINT, dates are DATE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.oracle import with_fx

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
ROWS_ONLY: set[str] = set()


def register(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a Spark query and (optionally) its oracle SQL body."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_fx(sql, extra)
        else:
            ROWS_ONLY.add(name)
        return fn

    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from tidemark.plans import queries_core  # noqa: F401
    from tidemark.plans import queries_derive  # noqa: F401
    from tidemark.plans import queries_reports  # noqa: F401
    from tidemark.plans import queries_quality  # noqa: F401
    from tidemark.plans import queries_ops  # noqa: F401
    from tidemark.plans import queries_more  # noqa: F401


_loaded = False


def queries() -> dict[str, QueryFn]:
    global _loaded
    if not _loaded:
        _load_all()
        _loaded = True
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
