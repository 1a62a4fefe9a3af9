"""Queries on forecasts by horizon: splits, baselines, metrics, tests, intervals, learned models and path models."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation, forecast, leakage, learning, site
from tidemark.operators.features import MEANS, STDS, VARIATIONS, with_features
from tidemark.plans.series_queries import positioned, six, with_indicators
from tidemark.sources.staging import staged_once

H, HORIZONS = 5, [5, 10, 20]
#: Parameter sets that the search draws beside the default, as workflows.train does.
DRAWS = 30
#: Features that are told apart by their association with the return.
ASSOCIATED = [*[f"variation_{k}" for k in VARIATIONS], *[f"rolling_mean_{k}_rel" for k in MEANS], *[f"rolling_std_{k}" for k in STDS]]
METRICS = ["mae", "rmse", "mape_pct", "smape_pct", "bias", "r2_level", "r2_return", "r2_oos_vs_naive", "directional_accuracy"]


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _data(spark, sf_dir, H)


def _data(spark: SparkSession, sf_dir: str, h: int) -> DataFrame:
    """The 31 features are made once for all queries: splits, folds and models read them."""
    feats = staged_once(spark, sf_dir, "features", lambda: with_features(positioned(spark, sf_dir)))
    return evaluation.horizon_dataset(feats, h)


def _baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.baseline_predictions(_dataset(spark, sf_dir), H)


def horizon_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def training_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.walk_forward_folds(_dataset(spark, sf_dir), H)


def metric_block_naive_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["series_id", "horizon", "split"]
    m = evaluation.metric_block(evaluation.by_model(_baselines(spark, sf_dir), ["naive", "drift"]), keys)
    return six(evaluation.with_ratios(m, keys), *METRICS, "mae_ratio_vs_naive", "rmse_ratio_vs_naive")


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluation.by_model(_baselines(spark, sf_dir).where("split = 'wf'"), ["naive", "drift"])
    return six(evaluation.metric_block(p, ["series_id", "fold"]).select("series_id", "fold", "model", "n", "mae", "rmse"), "mae", "rmse")


def cumulative_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluation.cumulative_gain(_baselines(spark, sf_dir).where("split = 'holdout'"), "drift")
    return six(g, "cumulative_gain").select("series_id", "row", "cumulative_gain")


def diebold_mariano_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.diebold_mariano(_baselines(spark, sf_dir).where("split = 'holdout'"), "drift", H)
    return six(d, "statistic", "p_two_sided", "p_better", "mean_loss_diff")


def diebold_mariano_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test without its probabilities, which SQL has no distribution for."""
    d = evaluation.diebold_mariano(_baselines(spark, sf_dir).where("split = 'holdout'"), "drift", H)
    return six(d.drop("p_two_sided", "p_better"), "statistic", "mean_loss_diff")


def bootstrap_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = evaluation.block_bootstrap(_baselines(spark, sf_dir).where("split = 'holdout'"), "drift", H)
    return six(b, "lower", "upper", "prob_below_1")


def conformal_interval_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluation.long_calibration(_baselines(spark, sf_dir).where("split = 'wf'"), "naive")
    return six(c, "q_abs", "sigma_floor", "q_norm")


def conformal_interval_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluation.calibration(_baselines(spark, sf_dir).where("split = 'wf'"), "naive")
    return six(c, "q_abs", "sigma_floor", "q_norm")


def interval_coverage_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _baselines(spark, sf_dir)
    c = evaluation.calibration(p.where("split = 'wf'"), "naive")
    return six(evaluation.coverage(p.where("split = 'holdout'"), c, "naive", "conformal_normalized"), "empirical_coverage", "mean_width")


def baseline_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's scores and places, of three forecasts that need no fit: no change, drift and half the drift."""
    return six(learning.search(_guesses(spark, sf_dir)), "cv_mean", "cv_std")


def baseline_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(learning.fold_scores(_guesses(spark, sf_dir)), "score")


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    wf = _baselines(spark, sf_dir).where("split = 'wf' and pred_return_drift is not null")
    guesses = F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), (F.lit(w) * F.col("pred_return_drift")).alias("pred_return")) for k, w in enumerate((0.0, 1.0, 0.5))]))
    return wf.select("series_id", "fold", "row", F.col("value_origin").alias("value"), "actual_return", guesses.alias("g")).select("*", "g.*").drop("g")


def feature_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances without a fitted model, over the development rows."""
    return six(_associations(spark, sf_dir), "gain", "permutation_rise")


def _associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.associations(_dataset(spark, sf_dir).where("split = 'dev'"), ASSOCIATED)


def snapshot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot's best features, beside its overview."""
    ind = staged_once(spark, sf_dir, "indicators", lambda: with_indicators(spark, sf_dir))
    snapshot = site.site_snapshot(positioned(spark, sf_dir), ind, importance=_associations(spark, sf_dir).withColumn("horizon", F.lit(H)))
    return six(snapshot.select("series_id", "observations", "last_value", F.inline("features_top")), "permutation_rise")


def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features do not look ahead at three cuts, targets are where they belong, and splits are purged."""
    s = positioned(spark, sf_dir)
    return leakage.leakage_report(s, with_features(s), H, [150, 700, 1500])


def _by_horizon(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """What make gives of the dataset, the ranked parameter sets and each horizon."""
    ranked = staged_once(spark, sf_dir, "ranked", lambda: _ranked(spark, sf_dir))
    out = [make(_data(spark, sf_dir, h), ranked.where(F.col("horizon") == h).drop("horizon"), h).withColumn("horizon", F.lit(h)) for h in HORIZONS]
    return reduce(DataFrame.unionByName, out)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search, once for all queries that build on it."""

    def one(h: int) -> DataFrame:
        sets = learning.parameter_sets(spark, DRAWS, h)
        return learning.search(learning.fold_predictions(_data(spark, sf_dir, h), h, sets)).join(sets, "candidate").withColumn("horizon", F.lit(h))

    return reduce(DataFrame.unionByName, [one(h) for h in HORIZONS])


def learned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter sets of the boosted trees by their walk-forward ratio, by horizon."""
    return _by_horizon(spark, sf_dir, lambda data, ranked, h: ranked)


def learned_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout predictions with the best parameter set of each series and horizon."""
    return _by_horizon(spark, sf_dir, lambda data, ranked, h: learning.holdout_predictions(data, ranked.where("place = 1")))


def learned_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances of the features with the best parameter set of each series and horizon."""
    return _by_horizon(spark, sf_dir, lambda data, ranked, h: learning.importances(data, ranked.where("place = 1"), h))


def path_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.model_scores(forecast.rolling_scores(positioned(spark, sf_dir)))


def selected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path model of each series, refitted, with bands."""
    s = positioned(spark, sf_dir)
    chosen = forecast.model_scores(forecast.rolling_scores(s)).where("place = 1")
    return forecast.forecast_paths(s, chosen)


QUERIES = [
    horizon_split, training_folds, metric_block_naive_drift, fold_metrics, cumulative_gain, diebold_mariano_drift, diebold_mariano_statistic, bootstrap_drift,
    conformal_interval_naive, conformal_interval_long, interval_coverage_naive, baseline_search, baseline_fold_scores, feature_associations, snapshot_features, leakage_report, learned_search, learned_holdout, learned_importances, path_model_scores, selected_paths,
]
