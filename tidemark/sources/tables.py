"""Virtual series over the provided tables: series_id, date (or ts), value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(df: DataFrame, series: str, day: str, amount: str) -> DataFrame:
    """Mean amount of each day: a decimal sum, which does not depend on the order, over the count."""
    mean = F.sum(F.col(amount).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    return df.groupBy(F.expr(series).alias("series_id"), F.to_date(day).alias("date")).agg(mean.alias("value"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "orders"), "'orders'", "o_orderdate", "o_totalprice")


def orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderdate", "o_totalprice")


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "orders"), "cast(o_custkey as string)", "o_orderdate", "o_totalprice")


def ship_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_shipdate", "l_extendedprice")


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
