"""Checks that nothing looks ahead: features, targets and splits of many series, each check a row with its verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluation import horizon_dataset, walk_forward_folds
from tidemark.operators.features import feature_names, with_features

TARGETS = {"return_h", "target_date", "target_value"}


def _differ(a: str, b: str) -> Column:
    near = F.abs(F.col(a) - F.col(b)) <= 1e-12 + 1e-9 * F.abs(F.col(b))
    return ~F.coalesce(near, F.col(a).isNull() & F.col(b).isNull())


def feature_checks(series: DataFrame, cuts: list[int], seed: int = 123) -> DataFrame:
    """At each cut: features there equal those of the series cut off after it, and of one whose future is noise.

    All cuts are one plan: every cut is a series of its own.  cuts is a short list of rows.
    """
    names = [c for kind in ("scale_free", "levels") for c in feature_names(kind)]
    at = F.broadcast(series.sparkSession.createDataFrame([(c,) for c in cuts], "cut int"))
    many = series.select(F.col("series_id").alias("own"), "date", "row", "value").crossJoin(at).withColumn("series_id", F.concat_ws("#", "own", "cut"))
    noise = 0.3 + 2.7 * F.pmod(F.xxhash64(F.lit(seed), "own", "row"), F.lit(1000)) / 1000
    noisy = many.withColumn("value", F.when(F.col("row") > F.col("cut"), F.col("value") * noise).otherwise(F.col("value")))
    full = with_features(series).select("series_id", "row", *dict.fromkeys(names))
    out = []
    for check, changed in (("truncation", many.where(F.col("row") <= F.col("cut"))), ("perturbation", noisy)):
        f = with_features(changed).select("series_id", "row", *[F.col(c).alias(f"{c}_cut") for c in dict.fromkeys(names)])
        f = f.withColumns({"cut": F.element_at(F.split("series_id", "#"), -1).cast("int"), "own": F.regexp_extract("series_id", "^(.*)#", 1)}).where(F.col("row") == F.col("cut"))
        both = full.join(f.drop("series_id", "row"), (full.series_id == f.own) & (full.row == f.cut))
        bad = reduce(lambda a, b: a | b, [_differ(c, f"{c}_cut") for c in dict.fromkeys(names)])
        out.append(both.groupBy("series_id").agg((F.count_if(bad) == 0).alias("ok"), F.count(F.lit(1)).alias("n")).withColumn("check", F.lit(check)))
    return out[0].unionByName(out[1]).select("series_id", "check", "ok", "n")


def target_checks(series: DataFrame, features: DataFrame, h: int) -> DataFrame:
    """Targets are the value and date h rows on, the last h rows have none, and no target is among the features."""
    clean = not TARGETS & {*feature_names("scale_free"), *feature_names("levels")}
    d = horizon_dataset(features, h)
    ahead = series.select("series_id", (F.col("row") - h).alias("row"), F.col("date").alias("date_on"), F.col("value").alias("value_on"))
    right = (F.col("target_date") == F.col("date_on")) & (F.abs(F.col("return_h") - (F.col("value_on") / F.col("value") - 1)) <= 1e-12)
    aligned = d.join(ahead, ["series_id", "row"], "left").groupBy("series_id").agg((F.count_if(~F.coalesce(right, F.lit(False))) == 0).alias("ok"), F.count(F.lit(1)).alias("n"), F.max("row").alias("newest"))
    ends = aligned.join(series.groupBy("series_id").agg(F.max("row").alias("end")), "series_id")
    return ends.select("series_id", F.explode(F.array(
        F.struct(F.lit(f"target h={h}").alias("check"), F.col("ok"), F.col("n")),
        F.struct(F.lit(f"last rows unlabelled h={h}").alias("check"), (F.col("newest") == F.col("end") - h).alias("ok"), F.col("n")),
        F.struct(F.lit("no target among features").alias("check"), F.lit(clean).alias("ok"), F.col("n")),
    )).alias("c")).select("series_id", "c.*")


def split_checks(features: DataFrame, h: int) -> DataFrame:
    """Development targets end before the test begins, and in every fold before the first row that is judged."""
    d = horizon_dataset(features, h)
    ends = d.groupBy("series_id").agg(F.max(F.when(F.col("split") == "dev", F.col("row") + h)).alias("dev_to"), F.min(F.when(F.col("split") == "test", F.col("row"))).alias("test_from"), F.count(F.lit(1)).alias("n"))
    holdout = ends.select("series_id", F.lit(f"holdout purged h={h}").alias("check"), (F.col("dev_to") < F.col("test_from")).alias("ok"), "n")
    inside = d.where("split = 'dev'").join(walk_forward_folds(d, h), "series_id")
    fold = inside.groupBy("series_id", "fold").agg(F.max(F.when(F.col("dev_row") < F.col("train_end"), F.col("row") + h)).alias("train_to"), F.min(F.when(F.col("dev_row") >= F.col("valid_from"), F.col("row"))).alias("first"), F.count(F.lit(1)).alias("n"))
    folds = fold.groupBy("series_id").agg(F.bool_and(F.col("train_to") < F.col("first")).alias("ok"), F.sum("n").alias("n"))
    return holdout.unionByName(folds.select("series_id", F.lit(f"folds purged h={h}").alias("check"), "ok", "n"))


def leakage_report(series: DataFrame, features: DataFrame, h: int, cuts: list[int]) -> DataFrame:
    """All checks of features, targets and splits: series_id, check, ok, n."""
    return feature_checks(series, cuts).unionByName(target_checks(series, features, h)).unionByName(split_checks(features, h))


def require_history(series: DataFrame, least: int) -> DataFrame:
    """series as it is; raises ValueError where one of its series has fewer than least observations."""
    short = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).limit(5).collect()
    if short:
        raise ValueError("too short: " + ", ".join(f"{r.series_id} ({r.n} of {least})" for r in short))
    return series
