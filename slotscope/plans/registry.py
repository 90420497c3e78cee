"""All queries of the compute-pool operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotscope.plans import allocation, feeds, jobs, queue, trends, views

FAMILIES = (allocation, views, trends, queue, jobs, feeds)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for f in FAMILIES for k, v in f.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for f in FAMILIES for k, v in f.ORACLE_SQL.items()}
