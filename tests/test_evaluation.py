import json
import hashlib
import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import boosted, univariate
from tidemark.operators import backtest, evaluation, features, forecast, indicators, learning, signals
from tidemark.sources.staging import staged

DAY = date(2020, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    rows = []
    for name, n in (("long", 1300), ("short", 300)):
        values = 1000 * np.exp(np.cumsum(rng.normal(0.0002, 0.01, n)))
        rows += [(name, DAY + timedelta(k), k, float(v)) for k, v in enumerate(values)]
    return staged(spark.createDataFrame(rows, "series_id string, date date, row int, value double"), "test-series")


def brute(v, signal, folds, h):
    out = []
    for fold, (train_end, lo, hi) in enumerate(folds):
        y = lambda a, b: v[a + h : b] / v[a : b - h] - 1
        train, s = y(0, train_end), signal[: train_end - h]
        cap, expected = max(np.quantile(np.abs(train), 0.9), 1e-6), {}
        for k in (-1, 0, 1):
            got = train[s == k]
            expected[k] = float(np.clip(np.median(got) if len(got) >= 20 else got.mean() if len(got) else 0.0, -cap, cap))
        valid, sv, base = y(lo, hi), signal[lo : hi - h], v[lo : hi - h]
        p = np.array([expected[k] for k in sv])
        moving = p != 0
        out.append((fold, np.abs(base * (p - valid)).mean(), np.abs(base * valid).mean(), (np.sign(p[moving]) == np.sign(valid[moving])).mean(), (sv != 0).mean(), len(valid)))
    return out


def test_backtest(spark, series):
    ind = indicators.with_indicators(series)
    sig = ind.select("series_id", "row", "value", F.lit(1).alias("candidate"), signals.signal("ma", fast=20, slow=50, neutral_band=0.003).alias("signal"))
    pdf = sig.where("series_id = 'long'").orderBy("row").toPandas()
    v, s, n = pdf.value.to_numpy(), pdf.signal.to_numpy(), len(pdf)
    dev = round(n * 0.8)
    first = dev - 5 - 600
    want = brute(v, s, [(first + 120 * k - 5, first + 120 * k, first + 120 * (k + 1)) for k in range(5)], 5)
    got = backtest.evaluate(sig, series, backtest.folds(series, 5), 5).orderBy("fold").collect()
    assert {r.series_id for r in got} == {"long"}  # the short series has no folds
    np.testing.assert_allclose([(r.mae, r.mae_naive, r.directional_accuracy, r.signal_coverage, r.n) for r in got], [w[1:] for w in want])
    want = brute(v, s, [(dev, dev, n)], 5)
    got = backtest.evaluate(sig, series, backtest.holdout_fold(series), 5).where("series_id = 'long'").collect()
    np.testing.assert_allclose([(r.mae, r.mae_naive, r.directional_accuracy, r.signal_coverage, r.n) for r in got], [w[1:] for w in want])


def test_many_rules_like_one_by_one(spark, series):
    """What tasks work out for many rules is what the column expressions say."""
    ind = staged(indicators.with_indicators(series), "i")
    rules = signals.sampled_candidates(spark, 12, 5)
    sig = signals.candidate_signals(ind, rules).drop("date", "strategy")
    for fold_table in (backtest.folds(series, 5), backtest.holdout_fold(series)):
        want = backtest.evaluate(sig, series, fold_table, 5).toPandas().sort_values(["series_id", "candidate", "fold"])
        got = backtest.evaluate_rules(ind, rules, fold_table, 5).toPandas().sort_values(["series_id", "candidate", "fold"])[want.columns]
        assert len(want) >= 24 and (got[["series_id", "candidate", "fold", "n"]].to_numpy() == want[["series_id", "candidate", "fold", "n"]].to_numpy()).all()
        np.testing.assert_allclose(got.iloc[:, 3:-1].to_numpy(float), want.iloc[:, 3:-1].to_numpy(float), rtol=1e-9)


def test_infinite_predictions_are_left_out(spark):
    rows = [("s", "m", 1.0, p, 0.1, r) for p, r in ((1.0, 0.1), (float("inf"), 0.1), (1.0, float("-inf")), (float("nan"), 0.1), (None, 0.1), (2.0, 0.2))]
    df = spark.createDataFrame(rows, "series_id string, model string, actual_value double, pred_value double, actual_return double, pred_return double")
    got = evaluation.metric_block(df, ["series_id"]).first()
    assert got.n == 2 and got.mae == 0.5


def test_unknown_direction_has_no_composite(spark):
    row = spark.createDataFrame([(1.0, None, 0.5)], "mae_ratio_mean double, directional_accuracy_mean double, signal_coverage_mean double")
    assert row.select(backtest.composite().alias("c")).first().c is None


def test_splits_do_not_overlap(series):
    for h in (5, 20):
        d = evaluation.horizon_dataset(staged(features.with_features(series), "f"), h).where("series_id = 'long'").toPandas()
        t0 = d.test_from.iloc[0]
        assert (d[d.split == "dev"].row + h < t0).all() and (d[d.split == "test"].row >= t0).all()
        assert d[d.split == "dev"].dev_row.tolist() == list(range((d.split == "dev").sum()))
        usable = np.arange(30, 1300)
        assert t0 == usable[round(len(usable) * 0.85)]


def test_student_t(spark):
    known = [(0.0, 5.0, 0.5), (2.015048, 5.0, 0.95), (-2.015048, 5.0, 0.05), (1.644854, 1e7, 0.95), (12.706205, 1.0, 0.975), (3.0, 242.0, 0.998508)]
    for t in (-40.0, -3.3, -0.7, -1e-4, 0.2, 1.0, 6.5, 300.0):
        known += [(t, 1.0, 0.5 + math.atan(t) / math.pi), (t, 2.0, 0.5 + t / 2 / math.sqrt(2 + t * t))]
    df = spark.createDataFrame([*known, (1.0, 0.0, None), (None, 5.0, None)], "t double, df double, want double")
    for r in df.withColumn("p", evaluation.student_cdf(F.col("t"), F.col("df"))).collect():
        assert r.p is r.want is None or abs(r.p - r.want) < 2e-5
        assert r.df not in (1.0, 2.0) or abs(r.t) == 12.706205 or abs(r.p - r.want) < 1e-12


def test_bootstrap_draws(spark):
    """Every resample by hand: blocks of consecutive rows, the last one cut."""
    rng = np.random.default_rng(2)
    n, h, reps = 37, 5, 60
    own, naive = rng.uniform(1, 2, n), rng.uniform(1, 2, n)
    rows = [("s", h, "holdout", k * 3, 0.0, float(naive[k]), float(own[k])) for k in range(n)] + [("one", h, "holdout", 0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, horizon int, split string, row int, actual_value double, pred_value_naive double, pred_value_m double")
    ratios = []
    for r in range(reps):
        at = []
        for b in range(4):
            begin = int(hashlib.md5(f"47:{r}:{b}".encode()).hexdigest()[:15], 16) % (n - 9)
            at += range(begin, begin + min(10, n - 10 * b))
        assert len(at) == n
        ratios.append(own[at].sum() / naive[at].sum())
    (got,) = evaluation.block_bootstrap(df, "m", h, reps).collect()
    lower, upper = np.quantile(ratios, (0.05, 0.95))
    assert abs(got.lower - lower) < 1e-12 and abs(got.upper - upper) < 1e-12 and got.n_boot == reps and got.prob_below_1 == np.mean(np.array(ratios) < 1)


def test_long_calibration(spark):
    rng = np.random.default_rng(7)
    rows = [(s, 5, float(rng.normal()), float(rng.normal()), float(rng.uniform(0.1, 2))) for s in "abc" for _ in range(211)]
    df = spark.createDataFrame(rows, "series_id string, horizon int, actual_return double, pred_return_m double, sigma_h double").repartition(5)
    got, want = ({r.series_id: r.asDict() for r in f(df, "m").collect()} for f in (evaluation.long_calibration, evaluation.calibration))
    assert got == want


def test_tests_and_intervals(spark):
    rng = np.random.default_rng(0)
    n, h = 240, 5
    a, naive, model = rng.normal(100, 3, n), rng.normal(100, 3, n), rng.normal(100, 2, n)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "horizon": h, "split": "holdout", "row": np.arange(n), "actual_value": a, "pred_value_naive": naive, "pred_value_m": model}))
    got = evaluation.diebold_mariano(df, "m", h).first()
    d = np.abs(model - a) - np.abs(naive - a)
    c = d - d.mean()
    var = (c @ c + sum(2 * (1 - k / h) * (c[k:] @ c[:-k]) for k in range(1, h))) / n
    stat = d.mean() / math.sqrt(var / n) * math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    assert abs(got.statistic - stat) < 1e-9 and got.n == n and 0 <= got.p_better <= 1
    boot = evaluation.block_bootstrap(df, "m", h).first()
    ratio = np.abs(model - a).mean() / np.abs(naive - a).mean()
    assert boot.lower < ratio < boot.upper and boot.block_length == 10
    assert boot == evaluation.block_bootstrap(df, "m", h).first()
    scores = spark.createDataFrame([(float(k),) for k in rng.permutation(19) + 1], "x double")
    assert [r.x for r in scores.withColumn("q", evaluation.at_conformal_place("x", [F.lit(1)], 0.9)).where("q").collect()] == [18.0]
    with pytest.raises(ValueError):
        evaluation.half_width("other", F.lit(1.0))


def test_boosted_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 6))
    y = 2 * x[:, 0] + np.sin(3 * x[:, 1])
    for objective in ("squared", "absolute"):
        m = boosted.fit(x[:600], y[:600], {"objective": objective, "learning_rate": 0.1, "reg_lambda": 1.0})
        assert np.abs(m.predict(x[600:]) - y[600:]).mean() < 0.5 * np.abs(y[600:] - y[:600].mean()).mean()
        assert m.gain[:2].min() > 2 * m.gain[2:].max()
    again = boosted.fit(x[:600], y[:600], {"objective": objective, "learning_rate": 0.1, "reg_lambda": 1.0})
    assert (again.predict(x) == m.predict(x)).all()


def test_learning(spark, series):
    d = staged(evaluation.horizon_dataset(staged(features.with_features(series), "f"), 5), "d")
    sets = spark.createDataFrame([(0, json.dumps({"n_estimators": 20})), (1, json.dumps({"n_estimators": 5}))], "candidate int, params string")
    p = learning.fold_predictions(d, 5, sets)
    assert {(r.candidate, r.fold, r["count"]) for r in p.groupBy("candidate", "fold").count().collect()} == {(c, f, 150) for c in (0, 1) for f in range(1, 6)}
    ranked = learning.search(p).collect()
    assert sorted(r.place for r in ranked) == [1, 2]
    best = spark.createDataFrame([("long", json.dumps({"n_estimators": 20}))], "series_id string, params string")
    hold = learning.holdout_predictions(d, best)
    assert hold.count() == d.where("series_id = 'long' and split = 'test'").count()
    imp = learning.importances(d, best, 5, repeats=2).toPandas()
    assert len(imp) == 31 and abs(imp.gain.sum() - 1) < 1e-9


def test_path_models():
    rng = np.random.default_rng(2)
    d = np.zeros(900)
    for t in range(1, 900):
        d[t] = 0.6 * d[t - 1] + rng.normal()
    y = 500 + np.cumsum(d)
    assert abs(univariate._ar_coefficient(np.diff(y)) - 0.6) < 0.1
    for name in univariate.MODELS:
        path, spread = univariate.fit_forecast(name, y, 20)
        assert path.shape == (20,) and np.isfinite(path).all() and spread > 0
    line = np.arange(300.0)
    np.testing.assert_allclose(univariate.fit_forecast("drift", line, 3)[0], [300, 301, 302])
    assert abs(univariate.fit_forecast("holt_damped", line, 1)[0][0] - 300) < 1
    with pytest.raises(ValueError):
        univariate.fit_forecast("other", y, 2)


def test_rolling_selection(series):
    scores = forecast.model_scores(forecast.rolling_scores(series, ["naive", "drift"])).toPandas()
    assert abs(scores[scores.model == "naive"].score - 1).max() < 1e-12
    chosen = forecast.model_scores(forecast.rolling_scores(series, ["naive"]))
    paths = forecast.forecast_paths(series, chosen).where("series_id = 'long'").orderBy("horizon").toPandas()
    assert len(paths) == 20 and (paths.lower95 < paths.lower80).all() and (paths.upper80 > paths.value).all()


def test_models_survive_a_table(spark, series, tmp_path):
    feats = staged(features.with_features(series), "f")
    d = staged(evaluation.horizon_dataset(feats, 5), "d")
    best = spark.createDataFrame([("long", json.dumps({"n_estimators": 15}))], "series_id string, params string")
    learning.fit_models(d, best, 5, splits="'dev'").write.parquet(str(tmp_path / "m"))
    got = learning.predict(spark.read.parquet(str(tmp_path / "m")), feats).select("series_id", "row", F.col("pred_return").alias("again"))
    both = learning.holdout_predictions(d, best).join(got, ["series_id", "row"]).toPandas()
    assert len(both) > 100
    np.testing.assert_allclose(both.again, both.pred_return)


def test_leak_checks(series):
    from tidemark.operators import leakage

    feats = staged(features.with_features(series), "f")
    rows = leakage.feature_checks(series, [31, 150, 299]).collect()
    assert {(r.series_id, r.check, r.n) for r in rows} == {(s, c, 3) for s in ("long", "short") for c in ("truncation", "perturbation")}
    rows += leakage.target_checks(series, feats, 5).collect() + leakage.split_checks(feats, 5).collect()
    assert all(r.ok for r in rows) and len(rows) >= 12
    late = series.withColumn("value", F.lead("value", 1).over(features.by_row())).dropna()
    assert not all(r.ok for r in leakage.target_checks(late, feats, 5).collect())
    with pytest.raises(ValueError):
        leakage.require_history(series, 301)
    assert leakage.require_history(series, 300) is series


def test_workflows(spark, series, tmp_path):
    from tidemark.plans import workflows

    raw = series.where("series_id = 'long'").select("series_id", F.col("row").alias("row_in_file"), F.col("date").cast("string").alias("date_raw"), F.col("value").cast("string").alias("value_raw"))
    got = workflows.train(spark, raw, str(tmp_path / "train"), draws=0, horizons=[5])[5].first()
    assert got.lower < got.value < got.upper and got.selected_model in ("trees", "naive") and got.approx_target_date > got.date
    assert spark.read.parquet(str(tmp_path / "train/h=5/importances")).count() == 31
    summary = workflows.search_strategies(spark, series.where("series_id = 'long'"), str(tmp_path / "strategy"), limit=8, horizons=[5, 10]).collect()
    assert [r.horizon for r in sorted(summary)] == [5, 10]
    known, observed = series.where("row < 290").drop("row"), series.where("row >= 285").drop("row")
    paths = workflows.refresh(spark, known, observed, str(tmp_path / "site")).collect()
    assert {r.series_id for r in paths} == {"long", "short"} and len(paths) == 40
    assert {r.added for r in spark.read.json(str(tmp_path / "site/status")).collect()} == {10, 1010}


def test_latest_quote(spark):
    from tidemark.functions.scalars import latest_quote

    pages = ["<h1>Marché officiel des changes</h1> 09/11/2026 <b>1 USD = 2 260,96 CDF</b>", "marché officiel des changes 31/12/2024 1 USD = 1.234,5 CDF", "1 USD = 5 CDF", "Marché officiel des changes 01/01/2024 1 USD = 1,2,3 CDF"]
    got = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", latest_quote(F.col("html")).alias("q")).orderBy("k").collect()
    assert [r.q and (str(r.q.date), r.q.value) for r in got] == [("2026-11-09", 2260.96), ("2024-12-31", 1234.5), None, None]


def test_selected_paths_chooses_among_all_models(monkeypatch):
    from tidemark.operators import forecast
    from tidemark.plans import training_queries

    class Scores:
        def where(self, condition):
            return condition

    seen = []
    monkeypatch.setattr(training_queries, "positioned", lambda spark, sf_dir: "series")
    monkeypatch.setattr(forecast, "rolling_scores", lambda series, models=forecast.MODELS: seen.append(list(models)))
    monkeypatch.setattr(forecast, "model_scores", lambda scores: Scores())
    monkeypatch.setattr(forecast, "forecast_paths", lambda series, chosen: chosen)
    training_queries.selected_paths(None, "")
    assert seen == [list(forecast.MODELS)]


def test_searches_have_the_sizes_of_whole_runs():
    import inspect

    from tidemark.plans import strategy_queries, training_queries, workflows

    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert strategy_queries.SEARCH_LIMIT == default(workflows.search_strategies, "limit")
    assert training_queries.DRAWS == default(workflows.train, "draws")
    assert strategy_queries.HORIZONS == training_queries.HORIZONS == workflows.HORIZONS
