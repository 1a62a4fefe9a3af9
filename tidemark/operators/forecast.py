"""Forecast paths of many series: rolling-origin selection among models, refit, and bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.univariate import MODELS, fit_forecast
from tidemark.sources.staging import spread

HORIZONS, ORIGINS, WINDOW, LEAST = [5, 10, 20], 12, 730, 100
Z80, Z95 = 1.2815515655, 1.9599639845


def origins(n: int, most: int = max(HORIZONS)) -> np.ndarray:
    """Up to twelve evenly spaced origins over the last part of a series of n observations."""
    final = n - most
    start = max(max(250, min(WINDOW, n - most - 20)), final - 440)
    return np.unique(np.linspace(start, final, ORIGINS, dtype=int))


def rolling_scores(series: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """Mean absolute path error of each model over the naive one: series_id, model, h, origin, ratio.

    A task holds one series and model; a model is fitted once for each origin and serves all horizons.
    """
    slim = series.select("series_id", "row", "value").crossJoin(F.broadcast(series.sparkSession.createDataFrame([(m,) for m in models], "model string")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y, out, most = part.sort_values("row")["value"].to_numpy(float), [], max(HORIZONS)
        name, key = part["model"].iloc[0], part["series_id"].iloc[0]
        if len(y) >= 250 + most:
            for origin in origins(len(y), most):
                train, actual = y[max(0, origin - WINDOW) : origin], y[origin : origin + most]
                path, _ = fit_forecast(name, train, most)
                for h in HORIZONS:
                    base = float(np.abs(actual[:h] - train[-1]).mean()) or 1.0
                    out.append((key, name, h, int(origin), float(np.abs(actual[:h] - path[:h]).mean()) / base))
        return pd.DataFrame(out, columns=["series_id", "model", "h", "origin", "ratio"])

    return spread(slim, "series_id", "model").groupBy("series_id", "model").applyInPandas(run, "series_id string, model string, h int, origin int, ratio double")


def model_scores(scores: DataFrame) -> DataFrame:
    """Mean ratio by model over origins and horizons, with the model's place (1 is best)."""
    by_h = scores.groupBy("series_id", "model", "h").agg(F.avg("ratio").alias("relative_mae"))
    score = by_h.groupBy("series_id", "model").agg(F.avg("relative_mae").alias("score"))
    return score.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy("score", "model")))


def forecast_paths(series: DataFrame, chosen: DataFrame, horizon: int = max(HORIZONS)) -> DataFrame:
    """Refit the chosen model (series_id, model) on the last 730 observations: horizon, value and 80 % and 95 % bands."""
    newest = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("row")))
    window = series.withColumn("age", newest).where(F.col("age") <= WINDOW).select("series_id", "row", "value").join(chosen.select("series_id", "model"), "series_id")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        path, spread = fit_forecast(part["model"].iloc[0], part.sort_values("row")["value"].to_numpy(float), horizon)
        return pd.DataFrame({"series_id": part["series_id"].iloc[0], "model": part["model"].iloc[0], "horizon": np.arange(1, horizon + 1, dtype=np.int32), "value": path, "spread": spread})

    return with_bands(spread(window, "series_id").groupBy("series_id").applyInPandas(run, "series_id string, model string, horizon int, value double, spread double"))


def with_bands(paths: DataFrame, z80: float = Z80, z95: float = Z95) -> DataFrame:
    """Add lower and upper bounds: value +- z * spread * sqrt(horizon)."""
    width: Column = F.col("spread") * F.sqrt("horizon")
    return paths.withColumns({f"{side}{name}": F.col("value") + sign * z * width for name, z in ((80, z80), (95, z95)) for side, sign in (("lower", -1), ("upper", 1))})


def naive_paths(series: DataFrame, horizon: int) -> DataFrame:
    """The last value, repeated; spread is the deviation of first differences."""
    return _paths(series, horizon, F.lit(0.0), "naive")


def drift_paths(series: DataFrame, horizon: int) -> DataFrame:
    """The line through the first and last observation, carried on."""
    return _paths(series, horizon, F.coalesce((F.col("last") - F.col("first")) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)), "drift")


def _paths(series: DataFrame, horizon: int, slope: Column, name: str) -> DataFrame:
    step = F.col("value") - F.lag("value").over(Window.partitionBy("series_id").orderBy("row"))
    ends = series.withColumn("step", step).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("value", "row").alias("first"), F.max_by("value", "row").alias("last"), F.coalesce(F.stddev_samp("step"), F.lit(1.0)).alias("spread"),
    )
    ahead = ends.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return with_bands(ahead.select("series_id", F.lit(name).alias("model"), "horizon", (F.col("last") + slope * F.col("horizon")).alias("value"), "spread"))


def recent_drift_paths(series: DataFrame, horizon: int = 30, recent: int = 60) -> DataFrame:
    """The fallback without any model: the mean of the last 60 differences, bands of 12 * sqrt(horizon)."""
    w = Window.partitionBy("series_id").orderBy("row")
    steps = series.withColumns({"step": F.col("value") - F.lag("value").over(w), "age": F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("row")))})
    mean = steps.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "row").alias("last"), F.avg(F.when(F.col("age") <= recent, F.col("step"))).alias("slope")).where("n >= 30")
    ahead = mean.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return with_bands(ahead.select("series_id", "horizon", (F.col("last") + F.col("horizon") * F.col("slope")).alias("value"), F.lit(12.0).alias("spread")), 1.28, 1.96)
