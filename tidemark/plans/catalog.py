"""All queries by name and DuckDB SQL that says the same, and the flagship.

Queries run over whole tables.  Where sums or recursions may add in another order, both sides round half up to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import oracles, series_queries, strategy_queries, training_queries

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages, trend signal, purged expectations and metrics against the naive forecast, from orders to one row per series."""
    return strategy_queries.strategy_holdout_metrics(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for module in (series_queries, strategy_queries, training_queries) for f in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
