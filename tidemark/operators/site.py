"""Figures that the site shows: latest change, recent averages, the technical snapshot and report lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.merge import last_rows

SNAPSHOT = ["ema_20", "ema_50", "ema_gap_20_50", "rsi_14", "macd", "macd_hist"]


def daily_pct(series: DataFrame) -> DataFrame:
    """Per cent change from the observation before, 0 where that is 0; the first row has none."""
    before = F.lag("value").over(Window.partitionBy("series_id").orderBy("row"))
    return series.withColumn("before", before).withColumn("pct", F.when(F.col("before") == 0, 0.0).otherwise((F.col("value") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)) * 100))


def pct_summary(series: DataFrame) -> DataFrame:
    """Mean and sample deviation of the changes; the deviation of fewer than two is 0."""
    return daily_pct(series).groupBy("series_id").agg(F.coalesce(F.avg("pct"), F.lit(0.0)).alias("average"), F.coalesce(F.stddev_samp("pct"), F.lit(0.0)).alias("std"))


def recent_stats(series: DataFrame, n: int = 20) -> DataFrame:
    """Last change, mean of the last n values, deviation of the last n changes, and where the mean lies in their range (0 to 100)."""
    recent = last_rows(daily_pct(series), n)
    s = recent.groupBy("series_id").agg(
        F.max_by("pct", "row").alias("last_pct"), F.avg("value").alias("average"), F.coalesce(F.stddev_samp("pct"), F.lit(0.0)).alias("volatility"), F.min("value").alias("low"), F.max("value").alias("high"),
    )
    place = (F.col("average") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * 100
    return s.withColumn("marker", F.greatest(F.lit(0.0), F.least(F.lit(100.0), place))).drop("low", "high")


def technical_snapshot(indicators: DataFrame) -> DataFrame:
    """The last row's indicators; momentum and volatility in per cent."""
    newest = last_rows(indicators, 1)
    return newest.select(
        "series_id", "date", "value", *SNAPSHOT,
        (F.col("ret_10") * 100).alias("momentum_10_pct"), (F.col("ret_20") * 100).alias("momentum_20_pct"), (F.col("vol_20") * 100).alias("volatility_20_pct"), F.col("range_pos_20").alias("range_position_20"),
    )


def series_overview(series: DataFrame) -> DataFrame:
    """Observations, first and last date and value, and the range."""
    return series.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("observations"), F.min("date").alias("start"), F.max("date").alias("last_date"), F.min_by("value", "date").alias("first_value"),
        F.max_by("value", "date").alias("last_value"), F.min("value").alias("value_min"), F.max("value").alias("value_max"),
    )


def since_training(series: DataFrame, trained: DataFrame) -> DataFrame:
    """trained (series_id, trained_through and more) with how many observations came after it; null where the series has no such day."""
    days = series.join(trained.select("series_id", "trained_through").distinct(), "series_id")
    age = days.groupBy("series_id", "trained_through").agg(F.bool_or(F.col("date") == F.col("trained_through")).alias("known"), F.count_if(F.col("date") > F.col("trained_through")).alias("later"))
    counted = age.select("series_id", "trained_through", F.when(F.col("known"), F.col("later")).alias("new_observations_since_training"))
    return trained.join(counted, ["series_id", "trained_through"], "left")


def site_snapshot(series: DataFrame, indicators: DataFrame, importance: DataFrame | None = None, **reports: DataFrame) -> DataFrame:
    """One row per series for the site: overview, indicators, a field for each report, and the best features (features_top) where importances are given.

    A report has series_id, horizon, trained_through and its own figures; it becomes an array of structs by horizon, with the
    observations since training, and is null for a series that it does not name.
    """
    tech = technical_snapshot(indicators)
    sign = F.when(F.col("ema_gap_20_50") > 0, 1).when(F.col("ema_gap_20_50") < 0, -1).otherwise(0)
    out = series_overview(series).join(tech.withColumn("ema_signal", sign).drop("date", "value"), "series_id", "left")
    for name, report in reports.items():
        aged = since_training(series, report)
        fields = ["horizon", *[c for c in aged.columns if c not in ("series_id", "horizon")]]
        out = out.join(aged.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name)), "series_id", "left")
    if importance is not None:
        best = top_features(importance, keys=["series_id", "horizon"], rank="permutation_rank")
        row = F.struct("horizon", "permutation_rank", "feature", "permutation_rise")
        out = out.join(best.groupBy("series_id").agg(F.sort_array(F.collect_list(row)).alias("features_top")), "series_id", "left")
    return out


def with_report(horizons: DataFrame, report: DataFrame, default: str = "naive") -> DataFrame:
    """Every horizon with its row of a report, where it has one; selected_model defaults to naive."""
    joined = horizons.join(report, "horizon", "left")
    return joined.withColumn("selected_model", F.coalesce("selected_model", F.lit(default)))


def top_features(importance: DataFrame, n: int = 6, keys: list[str] | None = None, rank: str = "perm_rank") -> DataFrame:
    """The n best-ranked features of each horizon, or of each of the keys."""
    w = Window.partitionBy(*(keys or ["horizon"])).orderBy(rank, "feature")
    return importance.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")
