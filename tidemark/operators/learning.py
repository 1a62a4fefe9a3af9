"""Boosted forecasts of returns by horizon: search, out-of-fold and holdout predictions, importances.

Spark deals out fits (series, parameter set, fold); each fit sees one series, which a task can hold.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import boosted
from tidemark.operators.evaluation import walk_forward_folds
from tidemark.operators.features import feature_names
from tidemark.sources.staging import spread, staged

#: Targets are fitted in per cent, so that penalties mean the same at every level.
SCALE, SEED, REPEATS = 100.0, 42, 10
#: The space that the search draws from.
SPACE = {
    "n_estimators": [100, 200, 300, 500], "max_depth": [2, 3, 4, 5], "learning_rate": [0.01, 0.02, 0.05, 0.1], "subsample": [0.6, 0.8, 1.0],
    "colsample_bytree": [0.5, 0.7, 0.9, 1.0], "min_child_weight": [1, 5, 10, 20, 50], "reg_alpha": [0.0, 0.001, 0.01, 0.1],
    "reg_lambda": [1.0, 5.0, 10.0, 50.0], "objective": ["squared", "absolute"],
}


def parameter_sets(spark: SparkSession, n: int, h: int) -> DataFrame:
    """The default, then n seeded draws from the space: candidate, is_default, params (JSON)."""
    rng = np.random.default_rng(SEED + h)
    draws = [{k: v[int(rng.integers(len(v)))] for k, v in SPACE.items()} for _ in range(n)]
    rows = [(0, True, json.dumps(boosted.DEFAULTS))] + [(k + 1, False, json.dumps(d)) for k, d in enumerate(draws)]
    return spark.createDataFrame(rows, "candidate int, is_default boolean, params string")


def _matrix(part: pd.DataFrame, kind: str) -> np.ndarray:
    return part[feature_names(kind)].to_numpy(float)


def fold_predictions(dataset: DataFrame, h: int, sets: DataFrame, kind: str = "scale_free", together: int = 1) -> DataFrame:
    """Out-of-fold predictions of every parameter set: series_id, candidate, fold, row, value, actual and predicted return.

    A series goes once to each task of about `together` parameter sets, whose candidates are numbered from 0 on; the task fits them on the
    training rows of each fold, which are cut into bins once, and predicts the fold's validation rows.  Fits differ much in cost, so there are
    several partitions for each task's key: Spark deals them out as workers become free.
    """
    names = feature_names(kind)
    dealt = sets.select("candidate", "params", F.expr(f"candidate div {together}").alias("task"))
    tasks = dealt.select("task").distinct()
    dev = dataset.where("split = 'dev'").select("series_id", "row", "dev_row", "value", "return_h", *names).crossJoin(F.broadcast(tasks))
    jobs = walk_forward_folds(dataset, h).crossJoin(F.broadcast(dealt))
    jobs = jobs.toDF(*jobs.columns)  # columns of its own, as both sides come from the same tables
    kinds = "series_id string, candidate int, fold int, row int, value double, actual_return double, pred_return double"

    def run(part: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        part, out = part.sort_values("dev_row"), []
        x, y, at = _matrix(part, kind), SCALE * part["return_h"].to_numpy(), part["dev_row"].to_numpy()
        for (train_end, valid_from, valid_to), own in jobs.groupby(["train_end", "valid_from", "valid_to"]):
            train, valid = at < train_end, (at >= valid_from) & (at < valid_to)
            binned = boosted.Binned.of(x[train])
            rows = part.loc[valid, ["series_id", "row", "value", "return_h"]].rename(columns={"return_h": "actual_return"})
            for job in own.itertuples():
                model = boosted.fit(x[train], y[train], json.loads(job.params), SEED, binned)
                out.append(rows.assign(candidate=job.candidate, fold=job.fold, pred_return=model.predict(x[valid]) / SCALE))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in kinds.split(", ")])

    parts = 4 * tasks.count()
    dev, jobs = (spread(df, "series_id", "task", parts=parts) for df in (dev, jobs))
    return dev.groupBy("series_id", "task").cogroup(jobs.groupBy("series_id", "task")).applyInPandas(run, kinds)


def fold_scores(predictions: DataFrame) -> DataFrame:
    """Ratio of each parameter set's mean absolute error to the naive one, by fold: score."""
    err = lambda c: F.avg(F.abs(F.col("value") * c))
    return predictions.groupBy("series_id", "candidate", "fold").agg((err(F.col("pred_return") - F.col("actual_return")) / F.nullif(err(F.col("actual_return")), F.lit(0.0))).alias("score"))


def search(predictions: DataFrame) -> DataFrame:
    """Parameter sets by mean ratio of fold errors to the naive ones: cv_mean, cv_std, folds_better, place."""
    sets = fold_scores(predictions).groupBy("series_id", "candidate").agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"), F.count_if(F.col("score") < 1).alias("folds_better"))
    return sets.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy("cv_mean", "candidate")))


def holdout_predictions(dataset: DataFrame, best: DataFrame, kind: str = "scale_free") -> DataFrame:
    """Fit each series' best parameter set (series_id, params) on its development rows and predict its test rows."""
    rows = dataset.where("split in ('dev', 'test')").select("series_id", "row", "split", "value", "return_h", *feature_names(kind)).join(best.select("series_id", "params"), "series_id")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        dev = part["split"] == "dev"
        model = boosted.fit(_matrix(part[dev], kind), SCALE * part.loc[dev, "return_h"].to_numpy(), json.loads(part["params"].iloc[0]), SEED)
        out = part.loc[~dev, ["series_id", "row", "value", "return_h"]].rename(columns={"return_h": "actual_return"})
        return out.assign(pred_return=model.predict(_matrix(part[~dev], kind)) / SCALE)

    return spread(rows, "series_id").groupBy("series_id").applyInPandas(run, "series_id string, row int, value double, actual_return double, pred_return double")


#: A fitted model as rows, one for each node of each tree.
NODES = "series_id string, horizon int, depth int, base double, tree int, node int, feature int, threshold double, left_child int, leaf double"


def fit_models(dataset: DataFrame, best: DataFrame, h: int, kind: str = "scale_free", splits: str = "'dev', 'test', 'purged'") -> DataFrame:
    """Fitted trees of each series as a table that any writer can keep, one row for each node."""
    rows = dataset.where(f"split in ({splits})").select("series_id", "row", "return_h", *feature_names(kind)).join(best.select("series_id", "params"), "series_id")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        model = boosted.fit(_matrix(part, kind), SCALE * part["return_h"].to_numpy(), json.loads(part["params"].iloc[0]), SEED)
        head = part["series_id"].iloc[0], h, model.params["max_depth"], model.base
        nodes = [(*head, k, j, *node) for k, tree in enumerate(model.trees) for j, node in enumerate(tree)]
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODES.split(", ")])

    return spread(rows, "series_id").groupBy("series_id").applyInPandas(run, NODES)


def predict(models: DataFrame, features: DataFrame, kind: str = "scale_free") -> DataFrame:
    """Predicted return of each row of features by its series' models: series_id, horizon, row, date, value, pred_return."""
    names = feature_names(kind)

    def run(key: tuple, rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (horizon, depth, base), nodes in fitted.groupby(["horizon", "depth", "base"]):
            columns = ["feature", "threshold", "left_child", "leaf"]
            trees = [list(t[columns].itertuples(index=False, name=None)) for _, t in nodes.sort_values(["tree", "node"]).groupby("tree")]
            model = boosted.Regressor({"max_depth": depth}, base, trees)
            part = rows[["series_id", "row", "date", "value"]].copy()
            part.insert(1, "horizon", horizon)
            out.append(part.assign(pred_return=model.predict(rows[names].to_numpy(float)) / SCALE))
        return pd.concat(out) if out else pd.DataFrame(columns=["series_id", "horizon", "row", "date", "value", "pred_return"])

    slim = features.dropna(subset=names).select("series_id", "row", "date", "value", *names)
    return slim.groupBy("series_id").cogroup(models.groupBy("series_id")).applyInPandas(run, "series_id string, horizon int, row int, date date, value double, pred_return double")


def joined_importances(gains: DataFrame, rises: DataFrame, keys: list[str]) -> DataFrame:
    """Two measures of each feature beside each other: gain as a share of the keys' sum, the rise, and the rank by it (1 is the largest; ties share one)."""
    both = gains.join(rises, [*keys, "feature"])
    share = F.col("gain") / F.coalesce(F.nullif(F.sum("gain").over(Window.partitionBy(*keys)), F.lit(0.0)), F.lit(1.0))
    return both.withColumn("gain", share).withColumn("permutation_rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("permutation_rise"))))


def associations(dataset: DataFrame, names: list[str]) -> DataFrame:
    """Importance of features without a fitted model: gain is the squared correlation with the return, permutation_rise its size. By series, in one aggregate."""
    each = dataset.groupBy("series_id").agg(*[F.coalesce(F.corr(c, "return_h"), F.lit(0.0)).alias(c) for c in names])
    long = each.select("series_id", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in names])).alias("f")).select("series_id", "f.*")
    return joined_importances(long.select("series_id", "feature", (F.col("r") * F.col("r")).alias("gain")), long.select("series_id", "feature", F.abs("r").alias("permutation_rise")), ["series_id"])


def importances(dataset: DataFrame, best: DataFrame, h: int, kind: str = "scale_free", repeats: int = REPEATS) -> DataFrame:
    """Normalised split gain, and the rise of the test error when a feature is permuted (mean, std over repeats), with ranks."""
    rows = dataset.where("split in ('dev', 'test')").select("series_id", "row", "split", "value", "return_h", *feature_names(kind)).join(best.select("series_id", "params"), "series_id")
    names = feature_names(kind)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        dev = part["split"] == "dev"
        model = boosted.fit(_matrix(part[dev], kind), SCALE * part.loc[dev, "return_h"].to_numpy(), json.loads(part["params"].iloc[0]), SEED)
        x, y, v = _matrix(part[~dev], kind), part.loc[~dev, "return_h"].to_numpy(), part.loc[~dev, "value"].to_numpy()
        error = lambda told: np.abs(v * (told / SCALE - y)).mean(-1)
        told, rng, out = model.predict(x), np.random.default_rng(SEED + h), []
        base = error(told)
        for j, name in enumerate(names):
            # All repeats together, and only the trees that ask for the feature.
            mixed, own = np.tile(x, (repeats, 1)), model.using(j)
            mixed[:, j] = np.concatenate([rng.permutation(x[:, j]) for _ in range(repeats)])
            moved = model.part(mixed, own).reshape(repeats, -1) - model.part(x, own)
            rises = error(told + moved) - base
            out.append((part["series_id"].iloc[0], name, float(model.gain[j]), float(np.mean(rises)), float(np.std(rises))))
        return pd.DataFrame(out, columns=["series_id", "feature", "gain", "permutation_rise", "permutation_std"])

    got = spread(rows, "series_id").groupBy("series_id").applyInPandas(run, "series_id string, feature string, gain double, permutation_rise double, permutation_std double")
    got = staged(got, "importances")
    return joined_importances(got.select("series_id", "feature", "gain"), got.drop("gain"), ["series_id"])
