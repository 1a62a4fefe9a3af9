"""Whole runs from observations to published tables: training, strategy search and the daily refresh."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import business_days_later
from tidemark.operators import audit, backtest, evaluation, features, forecast, indicators, learning, merge, signals, site
from tidemark.sources import sinks
from tidemark.sources.staging import staged

HORIZONS = [5, 10, 20]


def train(spark: SparkSession, raw: DataFrame, out: str, draws: int = 30, horizons: list[int] = HORIZONS) -> dict[int, DataFrame]:
    """Audit raw observations, tune and judge boosted trees by horizon, and write reports, models and forecasts under out.

    Returns the forecast of each horizon.  A series gets the trees only where they beat the naive forecast in walk-forward and
    holdout; its interval comes from the out-of-sample errors of the model that was selected.
    """
    series, excluded = audit.clean(raw)
    sinks.write_table(series, f"{out}/clean", "series_id")
    sinks.write_json(excluded, f"{out}/excluded")
    sinks.write_json(audit.quality_report(raw), f"{out}/quality")
    feats = staged(features.with_features(spark.read.parquet(f"{out}/clean")), "features")
    forecasts = {}
    for h in horizons:
        data = staged(evaluation.horizon_dataset(feats, h), "dataset")
        sets = learning.parameter_sets(spark, draws, h)
        folds = staged(learning.fold_predictions(data, h, sets), "folds")
        ranked = learning.search(folds)
        best = staged(ranked.where("place = 1").join(F.broadcast(sets), "candidate"), "best")
        hold = staged(_judged(data, learning.holdout_predictions(data, best), h, "holdout"), "holdout")
        wf = staged(_judged(data, folds.join(best.select("series_id", "candidate"), ["series_id", "candidate"], "left_semi"), h, "wf"), "wf")
        both = wf.unionByName(hold)
        keys = ["series_id", "horizon", "split"]
        metrics = evaluation.with_ratios(evaluation.metric_block(evaluation.by_model(both, ["trees", "naive", "drift"]), keys), keys)
        metrics = staged(metrics, "metrics")
        tests = evaluation.diebold_mariano(hold, "trees", h)
        boot = evaluation.block_bootstrap(hold, "trees", h)
        score = metrics.where("model = 'trees' and split = 'holdout'").select("series_id", F.col("mae_ratio_vs_naive").alias("holdout_ratio"))
        chosen = best.select("series_id", "cv_mean").join(score, "series_id").select("series_id", "cv_mean", "holdout_ratio", evaluation.selected(F.col("cv_mean"), F.col("holdout_ratio"), None, "trees").alias("selected_model"))
        models = staged(learning.fit_models(data, best, h), "models")
        newest = merge.last_rows(feats, 1)
        forecasts[h] = _forecast(learning.predict(models, newest), newest, chosen, both, h)
        for name, df in {"search": ranked, "fold_scores": learning.fold_scores(folds), "metrics": metrics, "predictions": both, "tests": tests, "bootstrap": boot, "selection": chosen, "models": models, "importances": learning.importances(data, best, h), "forecast": forecasts[h]}.items():
            df.write.mode("overwrite").parquet(f"{out}/h={h}/{name}")
    return forecasts


def _judged(data: DataFrame, predicted: DataFrame, h: int, split: str) -> DataFrame:
    """Predictions of the trees beside the naive and drift ones, as evaluation expects them."""
    own = predicted.select("series_id", "row", F.col("pred_return").alias("pred_return_trees"))
    v = F.col("value")
    return data.join(own, ["series_id", "row"]).select(
        "series_id", F.lit(h).alias("horizon"), F.lit(split).alias("split"), "row", F.col("date").alias("origin_date"), "target_date", v.alias("value_origin"),
        F.col("target_value").alias("actual_value"), F.col("return_h").alias("actual_return"), "pred_return_trees", (v * (1 + F.col("pred_return_trees"))).alias("pred_value_trees"),
        F.lit(0.0).alias("pred_return_naive"), v.alias("pred_value_naive"), features.drift_return(h).alias("pred_return_drift"), (v * (1 + features.drift_return(h))).alias("pred_value_drift"),
        (F.col("rolling_std_20") * math.sqrt(h)).alias("sigma_h"),
    )


def _forecast(predicted: DataFrame, newest: DataFrame, chosen: DataFrame, errors: DataFrame, h: int) -> DataFrame:
    """The last row's forecast with its interval and an approximate target date."""
    widths = [evaluation.calibration(errors, m).select("series_id", F.lit(m).alias("selected_model"), "q_abs", "q_norm", "sigma_floor") for m in ("trees", "naive")]
    width = evaluation.half_width("conformal_normalized", F.col("rolling_std_20") * math.sqrt(h))
    pred = F.when(F.col("selected_model") == "trees", F.col("pred_return")).otherwise(0.0)
    rows = predicted.join(newest.select("series_id", "rolling_std_20"), "series_id").join(chosen.select("series_id", "selected_model"), "series_id")
    rows = rows.join(widths[0].unionByName(widths[1]), ["series_id", "selected_model"])
    return rows.select(
        "series_id", "horizon", "date", F.col("value").alias("last_value"), F.round(F.col("value") * (1 + pred), 2).alias("value"),
        F.round(F.col("value") * (1 + pred - width), 2).alias("lower"), F.round(F.col("value") * (1 + pred + width), 2).alias("upper"),
        F.round(100 * pred, 4).alias("expected_return_pct"), "selected_model", business_days_later(F.col("date"), h).alias("approx_target_date"),
    )


def search_strategies(spark: SparkSession, series: DataFrame, out: str, limit: int = 360, horizons: list[int] = HORIZONS) -> DataFrame:
    """Search rules by walk-forward, judge the best on the holdout, apply the deployment rule, and write all reports under out."""
    ind = staged(indicators.with_indicators(series), "indicators")
    slim, summaries = ind.select("series_id", "date", "row", "value"), []
    for h in horizons:
        rules = signals.sampled_candidates(spark, limit, h)
        ranked = staged(backtest.ranked(backtest.fold_summary(backtest.evaluate_rules(ind, rules, backtest.folds(slim, h), h))), "ranked")
        best = staged(ranked.where("place = 1").join(F.broadcast(rules), "candidate"), "best")
        chosen = ind.select("series_id", "row", "date", "value", *signals.INPUTS).join(best.select("series_id", *rules.columns), "series_id")
        own = staged(signals.with_signals(chosen).select("series_id", "row", "date", "value", "candidate", "signal"), "own")
        hold = backtest.evaluate(own.drop("date"), slim, backtest.holdout_fold(slim), h).select("series_id", *[F.col(c).alias(f"holdout_{c}") for c in ("mae_ratio", "directional_accuracy", "signal_coverage")])
        params = F.to_json(F.struct("fast", "slow", "rsi_period", "mom_window", "rsi_bull", "rsi_bear", "neutral_band", "score_threshold"))
        summary = best.join(hold, "series_id").select(
            "series_id", F.lit(h).alias("horizon"), "strategy", params.alias("params"), F.col("mae_ratio_mean").alias("wf_mae_ratio"), F.col("directional_accuracy_mean").alias("wf_directional_accuracy"),
            *[c for c in hold.columns if c != "series_id"], backtest.deployed(F.col("mae_ratio_mean"), F.col("holdout_mae_ratio"), F.col("strategy")).alias("selected_model"),
        )
        ranked.write.mode("overwrite").parquet(f"{out}/h={h}/search")
        backtest.live_expectation(own, slim, h).write.mode("overwrite").parquet(f"{out}/h={h}/live")
        summaries.append(staged(summary, "summary"))
    total = summaries[0]
    for s in summaries[1:]:
        total = total.unionByName(s)
    sinks.write_csv(total, f"{out}/summary")
    return total


def refresh(spark: SparkSession, known: DataFrame, observed: DataFrame, out: str, **reports: DataFrame) -> DataFrame:
    """Upsert new observations, select and refit path models, and write series, counts, snapshot and forecast under out.

    reports (series_id, horizon, trained_through, ...) go into the snapshot under their names.
    """
    merge_ = staged(merge.merged(known, observed), "merge")
    series = features.with_position(merge_.select("series_id", "date", "value"))
    series = staged(series, "series")
    chosen = forecast.model_scores(forecast.rolling_scores(series)).where("place = 1")
    paths = forecast.forecast_paths(series, chosen)
    sinks.write_json(sinks.envelope(series), f"{out}/series")
    sinks.write_json(merge.merge_counts(merge_), f"{out}/status")
    sinks.write_json(site.site_snapshot(series, indicators.with_indicators(series), **reports), f"{out}/snapshot")
    sinks.write_json(paths, f"{out}/forecast")
    return paths

