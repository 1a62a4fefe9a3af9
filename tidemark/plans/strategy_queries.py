"""Queries on signals: single rules, the candidate grid, folds, expectations, evaluation, selection and the live forecast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest, signals
from tidemark.plans.series_queries import positioned, six, with_indicators
from tidemark.sources.staging import staged_once

#: The rule that single-rule queries use, and the horizon.
FAST, SLOW, BAND, H = 20, 50, 0.003, 5
#: Rules that the search query draws from the 945, and its horizons, as workflows.search_strategies has them.
SEARCH_LIMIT, HORIZONS = 360, [5, 10, 20]
METRICS = ["mae", "mae_naive", "mae_ratio", "rmse", "rmse_naive", "rmse_ratio", "directional_accuracy", "signal_coverage"]


def _signal(spark: SparkSession, sf_dir: str, strategy: str, **p) -> DataFrame:
    return with_indicators(spark, sf_dir).select("series_id", "row", signals.signal(strategy, fast=FAST, slow=SLOW, **p).alias("signal"))


def signal_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "ma", neutral_band=BAND)


def signal_ma_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "ma_rsi", rsi_period=14, rsi_bull=55.0, rsi_bear=45.0, neutral_band=BAND)


def signal_trend_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "trend_momentum", mom_window=10, neutral_band=BAND)


def signal_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "combo", rsi_period=14, mom_window=10, rsi_bull=55.0, rsi_bear=45.0, score_threshold=2)


def signal_combo_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "combo", strict=True, rsi_period=14, mom_window=10, rsi_bull=55.0, rsi_bear=45.0, score_threshold=2)


def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of each family and pair of averages, and the rows of each series on which that pair is there."""
    pairs = signals.candidates(spark).groupBy("strategy", "fast", "slow").agg(F.count(F.lit(1)).alias("n"))
    length = positioned(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    return length.crossJoin(F.broadcast(pairs)).select("series_id", "strategy", "fast", "slow", "n", F.greatest(F.col("rows") - F.col("slow") + 1, F.lit(0)).alias("n_rows"))


def unchosen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the sample left out, by family."""
    chosen = signals.sampled_candidates(spark, 360, H)
    return signals.candidates(spark).join(chosen, "candidate", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def fold_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each fold and role."""
    s = positioned(spark, sf_dir)
    one = s.select("series_id", "row", F.lit(0).alias("candidate"), F.lit(0).alias("signal"))
    rows = backtest.with_roles(one, s, backtest.folds(s, H), H)
    return rows.groupBy("series_id", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def _ma(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ind = with_indicators(spark, sf_dir)
    return ind.select("series_id", "row", "date", "value", F.lit(1).alias("candidate"), signals.signal("ma", fast=FAST, slow=SLOW, neutral_band=BAND).alias("signal")), positioned(spark, sf_dir)


def signal_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig, s = _ma(spark, sf_dir)
    out = backtest.expectations(backtest.with_roles(sig.drop("value", "date"), s, backtest.holdout_fold(s), H))
    return six(out, "expected").select("series_id", "signal", "n_train", "expected")


def _metrics(spark: SparkSession, sf_dir: str, holdout: bool) -> DataFrame:
    sig, s = _ma(spark, sf_dir)
    return backtest.evaluate(sig.drop("date"), s, backtest.holdout_fold(s) if holdout else backtest.folds(s, H), H)


def strategy_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(_metrics(spark, sf_dir, True), *METRICS).select("series_id", *METRICS, "n")


def walk_forward_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(_metrics(spark, sf_dir, False), *METRICS).select("series_id", "fold", *METRICS, "n")


def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["mae_ratio_mean", "mae_ratio_median", "directional_accuracy_mean", "signal_coverage_mean", "composite"]
    return six(backtest.fold_summary(_metrics(spark, sf_dir, False)), *names).select("series_id", *names)


def deploy_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    wf = backtest.fold_summary(_metrics(spark, sf_dir, False)).select("series_id", "mae_ratio_mean")
    ho = _metrics(spark, sf_dir, True).select("series_id", "mae_ratio")
    return wf.join(ho, "series_id").select("series_id", backtest.deployed(F.col("mae_ratio_mean"), F.col("mae_ratio"), F.lit("ma")).alias("selected_model"))


def holdout_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig, s = _ma(spark, sf_dir)
    rows = backtest.with_roles(sig, s, backtest.holdout_fold(s), H)
    p = backtest.predictions(rows, backtest.expectations(rows))
    v = F.col("value")
    out = p.select("series_id", "date", "value", (v * (1 + F.col("y"))).alias("actual_value"), (v * (1 + F.col("pred_return"))).alias("pred_value"), F.col("y").alias("actual_return"), "pred_return", "signal")
    return six(out, "actual_value", "pred_value", "actual_return", "pred_return")


def live_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig, s = _ma(spark, sf_dir)
    return six(backtest.live_expectation(sig, s, H), "expected_return", "lower", "upper").drop("candidate")


def candidate_signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of all 945 rules: how often each family says what."""
    s = signals.candidate_signals(with_indicators(spark, sf_dir), signals.candidates(spark))
    return s.groupBy("series_id", "strategy", "signal").agg(F.count(F.lit(1)).alias("n"))


def strategy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best rule of each series and horizon by walk-forward over a seeded sample of the grid."""
    s, ind = positioned(spark, sf_dir), staged_once(spark, sf_dir, "indicators", lambda: with_indicators(spark, sf_dir))

    def best(h: int) -> DataFrame:
        rules = signals.sampled_candidates(spark, SEARCH_LIMIT, h)
        found = backtest.best(backtest.fold_summary(backtest.evaluate_rules(ind, rules, backtest.folds(s, h), h)))
        return found.join(rules, "candidate").withColumn("horizon", F.lit(h))

    return reduce(DataFrame.unionByName, [best(h) for h in HORIZONS])


QUERIES = [
    signal_ma, signal_ma_rsi, signal_trend_momentum, signal_combo, signal_combo_strict, candidate_grid, unchosen_candidates, fold_range_join, signal_expectation,
    strategy_holdout_metrics, walk_forward_metrics, fold_summary, deploy_rule, holdout_predictions, live_forecast, candidate_signal_counts, strategy_search,
]
