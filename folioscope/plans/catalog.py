"""The query catalogue: every query of the engine by name, with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, layout_queries, lifecycle_queries, more_queries, reader_queries, segment_queries, stream_queries, text_queries

ALL = text_queries.QUERIES | segment_queries.QUERIES | layout_queries.QUERIES | stream_queries.QUERIES | more_queries.QUERIES | audit_queries.QUERIES | reader_queries.QUERIES | lifecycle_queries.QUERIES
ALL |= {k: (ALL[k][0], sql) for k, sql in lifecycle_queries.MORE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment audit."""
    return audit_queries.segment_audit(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in ALL.items() if sql}
