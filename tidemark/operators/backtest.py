"""Purged walk-forward and holdout evaluation of signals, for all series, rules and folds in one plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.signals import INPUTS, with_signals
from tidemark.sources.staging import spread

HORIZONS = [5, 10, 20]
TEST_SHARE, FOLDS, FOLD_SIZE = 0.20, 5, 120
LEAST_TRAIN = 100


def development_end(series: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """dev_end of each series: rows before it develop, the others are the holdout."""
    return series.groupBy("series_id").agg(F.bround(F.count(F.lit(1)) * (1 - test_share)).cast("int").alias("dev_end"))


def folds(series: DataFrame, h: int, test_share: float = TEST_SHARE, n: int = FOLDS, size: int = FOLD_SIZE) -> DataFrame:
    """Expanding folds: series_id, fold, train_end, valid_from, valid_to (ends are exclusive); h rows are purged before each.

    Series that are too short for all folds have none.
    """
    ends = development_end(series, test_share).withColumn("first", F.col("dev_end") - h - n * size).where(F.col("first") > LEAST_TRAIN)
    fold = ends.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("valid_from", F.col("first") + (F.col("fold") - 1) * size)
    return fold.select("series_id", "fold", (F.col("valid_from") - h).alias("train_end"), "valid_from", (F.col("valid_from") + size).alias("valid_to"))


def holdout_fold(series: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """The last split as a fold: all development rows train, all others are judged.  Nothing is purged: targets stay inside."""
    n = series.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("valid_to"))
    ends = development_end(series, test_share).join(n, "series_id")
    return ends.select("series_id", F.lit(0).alias("fold"), F.col("dev_end").alias("train_end"), F.col("dev_end").alias("valid_from"), "valid_to")


def with_roles(signals: DataFrame, series: DataFrame, fold_table: DataFrame, h: int) -> DataFrame:
    """Rows of each fold with role (train, valid), signal and y, the return over h observations.

    Targets are those inside the slice: the last h rows of either role have none, so no label crosses the edge.
    """
    ahead = series.select("series_id", "row", (F.lead("value", h).over(Window.partitionBy("series_id").orderBy("row")) / F.col("value") - 1).alias("y"))
    labelled = signals.join(ahead, ["series_id", "row"])
    train, valid = F.col("row") + h < F.col("train_end"), (F.col("row") >= F.col("valid_from")) & (F.col("row") + h < F.col("valid_to"))
    return labelled.join(fold_table, "series_id").where(train | valid).withColumn("role", F.when(train, "train").otherwise("valid"))


def expectations(rows: DataFrame) -> DataFrame:
    """Expected return of each signal in training: the median of 20 rows or more, the mean of fewer, within a cap.

    The cap is the 90th percentile of the fold's absolute returns, 1e-6 at least; it is the same for all rules.
    """
    train = rows.where("role = 'train'")
    cap = train.where(F.col("y").isNotNull()).dropDuplicates(["series_id", "fold", "row"]).groupBy("series_id", "fold").agg(F.greatest(F.percentile(F.abs("y"), 0.9), F.lit(1e-6)).alias("cap"))
    by = train.groupBy("series_id", "candidate", "fold", "signal").agg(F.count("y").alias("n_train"), F.median("y").alias("middle"), F.avg("y").alias("mean"))
    raw = F.when(F.col("n_train") >= 20, F.col("middle")).when(F.col("n_train") > 0, F.col("mean")).otherwise(0.0)
    joined = by.join(cap, ["series_id", "fold"])
    return joined.select("series_id", "candidate", "fold", "signal", "n_train", F.greatest(-F.col("cap"), F.least(F.col("cap"), raw)).alias("expected"))


def predictions(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows to judge with the expected return of their signal, 0 where training never saw it."""
    valid = rows.where("role = 'valid'")
    joined = valid.join(expected.select("series_id", "candidate", "fold", "signal", "expected"), ["series_id", "candidate", "fold", "signal"], "left")
    return joined.withColumn("pred_return", F.coalesce("expected", F.lit(0.0))).drop("expected")


def signal_metrics() -> list[Column]:
    """Aggregates over predictions: errors in level units, ratios to the naive forecast, direction and coverage."""
    err = F.col("value") * (F.col("pred_return") - F.col("y"))
    naive = F.col("value") * F.col("y")
    mae, mae_naive, rmse, rmse_naive = F.avg(F.abs(err)), F.avg(F.abs(naive)), F.sqrt(F.avg(err * err)), F.sqrt(F.avg(naive * naive))
    right = F.when(F.signum("pred_return") != 0, (F.signum("pred_return") == F.signum("y")).cast("double"))
    infinite = F.lit(float("inf"))
    return [
        mae.alias("mae"),
        mae_naive.alias("mae_naive"),
        F.when(mae_naive > 0, mae / mae_naive).otherwise(infinite).alias("mae_ratio"),
        rmse.alias("rmse"),
        rmse_naive.alias("rmse_naive"),
        F.when(rmse_naive > 0, rmse / rmse_naive).otherwise(infinite).alias("rmse_ratio"),
        F.avg(right).alias("directional_accuracy"),
        F.avg((F.col("signal") != 0).cast("double")).alias("signal_coverage"),
        F.count(F.lit(1)).alias("n"),
    ]


def evaluate(signals: DataFrame, series: DataFrame, fold_table: DataFrame, h: int) -> DataFrame:
    """Metrics of each series, rule and fold."""
    rows = with_roles(signals, series, fold_table, h)
    return predictions(rows, expectations(rows)).groupBy("series_id", "candidate", "fold").agg(*signal_metrics())


#: Rules that a task judges at a time.
TOGETHER = 40


def evaluate_rules(indicators: DataFrame, rules: DataFrame, fold_table: DataFrame, h: int) -> DataFrame:
    """The metrics of evaluate for many rules (a grid of at most 945): series_id, candidate, fold and signal_metrics.

    A series crosses the network once for each chunk of TOGETHER rules and becomes rows by rule only where it is judged: signals are
    column expressions there, exact medians of many small groups are numpy.  A task holds one series, whose rows are days.
    """
    dealt = rules.withColumn("task", F.expr(f"candidate div {TOGETHER}").cast("int"))
    tasks = F.broadcast(dealt.select("task").distinct())
    rows = spread(indicators.select("series_id", "row", "value", *INPUTS).crossJoin(tasks), "series_id", "task")
    judged = with_signals(rows.join(F.broadcast(dealt), "task")).select("series_id", "task", "candidate", "row", "value", "signal")
    jobs = spread(fold_table.crossJoin(tasks), "series_id", "task")
    jobs = jobs.toDF(*jobs.columns)  # columns of its own, as both sides come from the same tables
    names = ["mae", "mae_naive", "mae_ratio", "rmse", "rmse_naive", "rmse_ratio", "directional_accuracy", "signal_coverage"]
    kinds = "series_id string, candidate int, fold int, " + ", ".join(f"{c} double" for c in names) + ", n long"

    def run(part: pd.DataFrame, folds: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["candidate", "row"], kind="stable")
        candidates = part["candidate"].unique()
        value, said = part["value"].to_numpy().reshape(len(candidates), -1)[0], part["signal"].to_numpy().reshape(len(candidates), -1)
        move = value[h:] / value[:-h] - 1
        out = []
        for fold in folds.itertuples():
            past, now = slice(0, max(0, fold.train_end - h)), slice(fold.valid_from, max(fold.valid_from, fold.valid_to - h))
            train, actual, base = move[past], move[now], value[now]
            cap = max(float(np.quantile(np.abs(train), 0.9)), 1e-6)
            naive = base * actual
            for candidate, signal in zip(candidates.tolist(), said, strict=True):
                expected = [_expected(train[signal[past] == s], cap) for s in (-1, 0, 1)]
                out.append((fold.series_id, candidate, fold.fold, *_judged(np.take(expected, signal[now] + 1), actual, base, naive, signal[now])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")])

    return judged.groupBy("series_id", "task").cogroup(jobs.groupBy("series_id", "task")).applyInPandas(run, kinds)


def _expected(moves: np.ndarray, cap: float) -> float:
    """What expectations says of a signal that was followed by these returns."""
    n = len(moves)
    if n >= 20:
        low, high = (n - 1) // 2, n // 2
        middle = np.partition(moves, (low, high))
        return min(cap, max(-cap, (middle[low] + middle[high]) / 2))
    return min(cap, max(-cap, moves.mean())) if n else 0.0


def _judged(told: np.ndarray, actual: np.ndarray, base: np.ndarray, naive: np.ndarray, signal: np.ndarray) -> tuple:
    """signal_metrics of one rule in one fold."""
    n = len(actual)
    if not n:
        return (None,) * 8 + (0,)
    error, moving = base * (told - actual), told != 0
    mae, mae_naive, rmse, rmse_naive = np.abs(error).mean(), np.abs(naive).mean(), np.sqrt((error**2).mean()), np.sqrt((naive**2).mean())
    right = (np.sign(told[moving]) == np.sign(actual[moving])).mean() if moving.any() else None
    over = lambda a, b: a / b if b > 0 else np.inf
    return mae, mae_naive, over(mae, mae_naive), rmse, rmse_naive, over(rmse, rmse_naive), right, (signal != 0).mean(), n


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean and median ratio, mean direction and coverage over the folds, and the composite score (lower is better)."""
    s = metrics.groupBy("series_id", "candidate").agg(
        F.avg("mae_ratio").alias("mae_ratio_mean"),
        F.median("mae_ratio").alias("mae_ratio_median"),
        F.avg("directional_accuracy").alias("directional_accuracy_mean"),
        F.avg("signal_coverage").alias("signal_coverage_mean"),
    )
    return s.withColumn("composite", composite())


def composite() -> Column:
    """Level error first, then direction and coverage; null where the direction is unknown."""
    level = F.least(F.greatest(F.col("mae_ratio_mean") - 1, F.lit(-0.5)), F.lit(1.0))
    direction = F.when(F.col("directional_accuracy_mean").isNotNull(), F.greatest(F.col("directional_accuracy_mean") - 0.5, F.lit(-0.25)))
    return level - 0.5 * direction + 0.05 * F.abs(F.col("signal_coverage_mean") - 0.6)


def ranked(summary: DataFrame) -> DataFrame:
    """Rules of each series by composite, then ratio, then direction; candidate settles ties."""
    order = [F.asc_nulls_last("composite"), F.asc("mae_ratio_mean"), F.desc("directional_accuracy_mean"), F.asc("candidate")]
    return summary.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy(*order)))


def best(summary: DataFrame) -> DataFrame:
    return ranked(summary).where("place = 1").drop("place")


def deployed(walk_forward: Column, holdout: Column, name: Column) -> Column:
    """A model goes live only if it beats the naive forecast in walk-forward and in the holdout."""
    return F.when((walk_forward < 1) & (holdout < 1), name).otherwise("naive")


def live_expectation(signals: DataFrame, series: DataFrame, h: int) -> DataFrame:
    """Last signal of each rule with its expected return over all history and the 10 % and 90 % quantiles of returns.

    The quantiles are of rows with the same signal, or of all rows where fewer than 30 have it.
    """
    n = series.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("train_end"))
    everything = n.select("series_id", F.lit(0).alias("fold"), "train_end", F.col("train_end").alias("valid_from"), F.col("train_end").alias("valid_to"))
    rows = with_roles(signals, series, everything, h)
    newest = signals.groupBy("series_id", "candidate").agg(F.max_by("signal", "row").alias("signal"), F.max_by("value", "row").alias("value"), F.max("date").alias("date"))
    expected = newest.join(expectations(rows), ["series_id", "candidate", "signal"], "left")
    q = lambda c, p: F.percentile(c, p)
    own = rows.withColumnRenamed("signal", "s").join(newest.select("series_id", "candidate", "signal"), ["series_id", "candidate"])
    mine = F.when(F.col("s") == F.col("signal"), F.col("y"))
    bands = own.groupBy("series_id", "candidate").agg(F.count(mine).alias("n_same"), q(mine, 0.1).alias("lo_same"), q(mine, 0.9).alias("hi_same"), q(F.col("y"), 0.1).alias("lo_all"), q(F.col("y"), 0.9).alias("hi_all"))
    few = F.col("n_same") < 30
    out = expected.join(bands, ["series_id", "candidate"])
    return out.select(
        "series_id", "candidate", "date", "value", "signal",
        F.coalesce("expected", F.lit(0.0)).alias("expected_return"),
        (F.col("value") * (1 + F.when(few, F.col("lo_all")).otherwise(F.col("lo_same")))).alias("lower"),
        (F.col("value") * (1 + F.when(few, F.col("hi_all")).otherwise(F.col("hi_same")))).alias("upper"),
    )
