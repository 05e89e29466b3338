"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from confluo.plans import feed_queries, live_queries, more_queries, panel_queries, rule_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return rule_queries.QUERIES | live_queries.QUERIES | panel_queries.QUERIES | more_queries.QUERIES | feed_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return rule_queries.SQL | live_queries.SQL | panel_queries.SQL | more_queries.SQL | feed_queries.SQL
