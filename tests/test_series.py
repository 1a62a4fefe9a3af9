from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.recursive import averaged_in_sql, span
from tidemark.functions.scalars import business_days_later, quote_rate, quoted_number
from tidemark.operators import audit, features, indicators, merge, signals, site

DAY = date(2024, 1, 1)


def frame(spark, values, series_id="s"):
    rows = [(series_id, DAY + timedelta(k), k, None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, date date, row int, value double")


def walk(n, seed=0):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))


def table(df, *columns):
    return df.orderBy("series_id", "row").select(*columns).toPandas()


def test_quotes(spark):
    cases = {"1.234,5": 1234.5, "1,234.5": 1234.5, "2260,96": 2260.96, "2 260,96": 2260.96, "junk": None, "1,2,3": None, "12d": None}
    got = spark.createDataFrame(list(enumerate(cases)), "k int, raw string").select("k", quoted_number(F.col("raw")).alias("v")).orderBy("k").collect()
    assert [r.v for r in got] == list(cases.values())
    pages = {"<b>USD</b> (cours moyen)<i>: </i>2 260,96 ": 2260.96, "usd ..... 600": 600.0, "USD (cours moyen) 12": None, "EUR 900": None, None: None}
    got = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", quote_rate(F.col("html")).alias("v")).orderBy("k").collect()
    assert [r.v for r in got] == list(pages.values())


def test_business_days(spark):
    days = [DAY + timedelta(k) for k in range(14)]
    for n in (1, 4, 5, 11):
        got = spark.createDataFrame([(d,) for d in days], "d date").select(business_days_later(F.col("d"), n).alias("x")).collect()
        assert [r.x for r in got] == [np.busday_offset(d, n, roll="backward").astype(date) for d in days]


def test_features_like_pandas(spark):
    v = pd.Series(walk(120))
    got = table(features.with_features(frame(spark, v)), "*")
    for k in features.LAGS:
        np.testing.assert_allclose(got[f"lag_{k}_rel"], v.shift(k) / v - 1)
    for k in features.STDS:
        np.testing.assert_allclose(got[f"rolling_std_{k}"], v.pct_change().rolling(k).std())
        np.testing.assert_allclose(got[f"trend_{k}_level"], v.rolling(k).apply(lambda w: np.polyfit(range(len(w)), w, 1)[0], raw=True), atol=1e-9)
    np.testing.assert_allclose(got["drift_ratio"], v / v.shift(60))
    assert len(features.feature_names("scale_free")) == len(features.feature_names("levels")) == 31
    with pytest.raises(ValueError):
        features.feature_names("other")


@pytest.mark.parametrize("cut", [40, 77, 119])
def test_nothing_looks_ahead(spark, cut):
    v = walk(120)
    changed = np.concatenate((v[:cut], v[cut:] * np.random.default_rng(1).uniform(0.3, 3, 120 - cut)))
    for make in (features.with_features, indicators.with_indicators):
        full = table(make(frame(spark, v)), "*")[:cut]
        for other in (v[:cut], changed):
            pd.testing.assert_frame_equal(full, table(make(frame(spark, other)), "*")[:cut], rtol=1e-9)


def test_indicators_like_pandas(spark):
    v = pd.Series(walk(150, 3))
    got = table(indicators.with_indicators(frame(spark, v)), "*")
    np.testing.assert_allclose(got["ema_20"], v.ewm(span=20, adjust=False, min_periods=20).mean())
    assert got["rsi_14"].first_valid_index() == 14
    assert got["macd_signal"].first_valid_index() == 33
    fast, slow = (v.ewm(span=n, adjust=False, min_periods=n).mean() for n in (12, 26))
    np.testing.assert_allclose(got["macd_signal"], (fast - slow).ewm(span=9, adjust=False, min_periods=9).mean())
    sql = table(frame(spark, v).withColumn("e", averaged_in_sql(span("e", "value", 20))), "e")
    np.testing.assert_allclose(sql["e"], got["ema_20"])


def test_rsi_edges(spark):
    for values, want in ((range(1, 61), 100.0), (range(60, 0, -1), 0.0), ([5] * 60, None)):
        last = table(indicators.with_indicators(frame(spark, values)), "rsi_14", "range_pos_20").iloc[-1]
        assert (pd.isna(last.rsi_14) if want is None else last.rsi_14 == want)
        assert pd.isna(last.range_pos_20) == (want is None)


def excursions(values):
    out = [False] * len(values)
    for first in range(1, len(values)):
        for end in range(first + 1, min(first + 6, len(values))):
            before, after, block = values[first - 1], values[end], values[first:end]
            if abs(after / before - 1) <= 0.02 and all(abs(b / before - 1) >= 0.10 for b in block):
                out[first:end] = [True] * len(block)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from([100.0, 101.0, 110.5, 130.0, 70.0, 99.0]), min_size=1, max_size=40))
def test_excursions(spark, values):
    got = audit.with_excursions(frame(spark, values)).orderBy("row").collect()
    assert [r.excursion for r in got] == excursions(values)


def test_audit(spark):
    raw = [("2024-01-02", "101"), ("2024-01-01", "100,5"), ("junk", "1"), ("2024-01-03", "n/a"), ("2024-01-04", "-1"), ("2024-01-05", None), ("2024-01-06", "inf"), ("2024-01-01", "100.5"), ("2024-01-07", "1,234.5")]
    df = spark.createDataFrame([("s", k, d, v) for k, (d, v) in enumerate(raw)], "series_id string, row_in_file int, date_raw string, value_raw string")
    kept, excluded = audit.clean(df)
    assert [(str(r.date), r.row, r.value) for r in kept.orderBy("row").collect()] == [("2024-01-01", 0, 100.5), ("2024-01-02", 1, 101.0)]
    assert {r.row_in_file: r.reason for r in excluded.collect()} == {2: audit.BAD_DATE, 3: audit.BAD_NUMBER, 4: audit.NOT_POSITIVE, 5: audit.BAD_NUMBER, 6: audit.NOT_FINITE, 8: audit.BAD_NUMBER}
    counts = audit.flag_counts(audit.with_flags(df)).first()
    assert (counts.n_rows, counts.bad_date, counts.missing, counts.non_numeric, counts.non_positive, counts.non_finite) == (9, 1, 1, 2, 1, 1)
    clash = spark.createDataFrame([("s", 0, "2024-01-01", "1"), ("s", 1, "2024-01-01", "2")], df.schema)
    with pytest.raises(audit.DataQualityError):
        audit.clean(clash)
    spike = spark.createDataFrame([("s", k, str(DAY + timedelta(k)), v) for k, v in enumerate(["100", "100", "150", "101", "100"])], df.schema)
    kept, excluded = audit.clean(spike)
    assert [r.row for r in kept.orderBy("date").collect()] == [0, 1, 2, 3]
    assert [r.reason for r in excluded.collect()] == [audit.REVERTED]
    assert audit.clean(spike, keep_excursions=True)[0].count() == 5


def test_flat_series_has_no_extremes(spark):
    assert audit.robust_extremes(frame(spark, [5] * 25)).count() == 0


def test_combo_truth_table(spark):
    side = [-1.0, 0.0, 1.0, None]
    rows = [(a, b, c, d) for a in side for b in side for c in side for d in side]
    df = spark.createDataFrame(rows, "g double, m double, r double, h double").withColumn("rsi", 50 + 10 * F.col("r"))
    args = [F.col("g"), F.col("m"), F.col("rsi"), F.col("h"), F.lit(55.0), F.lit(45.0)]
    for threshold in (2, 3):
        for strict in (False, True):
            got = df.select("g", "m", "r", "h", signals.combo(*args, F.lit(threshold), strict).alias("s")).collect()
            for x in got:
                votes = sum(v or 0 for v in (x.g, x.m, x.r, x.h))
                silent = None in (x.g, x.m, x.r, x.h) if strict else x.g is None
                assert x.s == (0 if silent else 1 if votes >= threshold else -1 if votes <= -threshold else 0)


def test_candidates(spark):
    assert signals.candidates(spark).count() == 945
    chosen = signals.sampled_candidates(spark, 40, 5).toPandas()
    assert len(chosen) == 40 and chosen.candidate.is_unique and set(chosen.groupby("strategy").size()) == {10}
    assert chosen.equals(signals.sampled_candidates(spark, 40, 5).toPandas())
    with pytest.raises(ValueError):
        signals.signal("other", fast=5, slow=30)


def test_grid_equals_single_rules(spark):
    ind = indicators.with_indicators(frame(spark, walk(150)))
    rules = signals.candidates(spark)
    for strategy, p in {
        "ma": {"neutral_band": 0.003}, "ma_rsi": {"rsi_period": 14, "rsi_bull": 60.0, "rsi_bear": 40.0, "neutral_band": 0.001},
        "trend_momentum": {"mom_window": 10, "neutral_band": 0.001}, "combo": {"rsi_period": 7, "mom_window": 5, "rsi_bull": 55.0, "rsi_bear": 45.0, "score_threshold": 3},
    }.items():
        one = rules.where(F.col("strategy") == strategy).where("fast = 5 and slow = 30")
        for k, v in p.items():
            one = one.where(F.col(k) == v)
        assert one.count() == 1
        got = signals.candidate_signals(ind, one).select("row", "signal")
        want = ind.select("row", signals.signal(strategy, fast=5, slow=30, **p).alias("signal"))
        assert sorted(got.collect()) == sorted(want.collect())


def test_merge(spark):
    old = spark.createDataFrame([("s", DAY, 1.0), ("s", DAY + timedelta(1), 2.0), ("s", DAY + timedelta(2), 3.0)], "series_id string, date date, value double")
    new = spark.createDataFrame([("s", DAY + timedelta(1), 2.0 + 1e-12), ("s", DAY + timedelta(2), 3.5), ("s", DAY + timedelta(3), 4.0)], old.schema)
    got = {str(r.date): (r.value, r.status) for r in merge.merged(old, new).collect()}
    assert [got[k][1] for k in sorted(got)] == ["unchanged", "unchanged", "corrected", "added"]
    assert merge.merge_counts(merge.merged(old, new)).first()[1:] == (4, 1, 1)


def test_small_site_figures(spark):
    one = site.pct_summary(frame(spark, [5])).first()
    assert (one.average, one.std) == (0.0, 0.0)
    picks = merge.quartile_picks(frame(spark, range(1, 11))).orderBy("row").collect()
    assert [r.row for r in picks] == [0, 2, 5, 7, 9]
    assert merge.quartile_picks(frame(spark, [1])).count() == 1


def test_quality_report_of_a_series_without_valid_rows_and_with_excursions(spark):
    from tidemark.operators import audit

    days = [("ok", k, f"2024-01-{k + 1:02d}", "200" if k == 4 else str(100 + k % 2)) for k in range(9)]
    raw = spark.createDataFrame([*days, ("ok", 9, "2024-01-09", "100"), ("none", 0, "soon", "1"), ("none", 1, "2024-01-01", None)], "series_id string, row_in_file int, date_raw string, value_raw string")
    got = {r.series_id: r for r in audit.quality_report(raw).collect()}
    ok, none = got["ok"], got["none"]
    assert (ok.n_rows, ok.n_duplicate_dates, ok.n_excursions, ok.n_rows_clean, ok.n_rows_excluded, ok.chronological) == (10, 1, 1, 8, 1, True)
    assert [tuple(g) for g in ok.gaps] == [(1, 8)] and ok.distant == [] and sum(w.n for w in ok.weekdays) == 9
    assert (none.n_rows, none.bad_date, none.missing, none.n_rows_clean, none.n_rows_excluded, none.last_value, none.gaps) == (2, 1, 1, 0, 2, None, None)
    kept = {r.series_id: r for r in audit.quality_report(raw, keep_excursions=True).collect()}["ok"]
    assert (kept.n_rows_clean, kept.n_rows_excluded, kept.value_max) == (9, 0, 200.0)
    assert audit.quality_report(raw.limit(0)).collect() == []


def test_site_snapshot_counts_observations_since_training(spark):
    from tidemark.operators import features, indicators, site

    rows = [(s, f"2024-01-{k:02d}", float(k)) for s in ("a", "b") for k in range(1, 8)]
    series = features.with_position(spark.createDataFrame(rows, "series_id string, day string, value double").selectExpr("series_id", "to_date(day) as date", "value"))
    report = spark.createDataFrame([("a", 10, "2024-01-05"), ("a", 5, "2023-01-01")], "series_id string, horizon int, day string").selectExpr("series_id", "horizon", "to_date(day) as trained_through")
    got = {r.series_id: r for r in site.site_snapshot(series, indicators.with_indicators(series), learned=report).collect()}
    assert [(f.horizon, f.new_observations_since_training) for f in got["a"].learned] == [(5, None), (10, 2)]
    assert got["b"].learned is None and got["b"].observations == 7 and got["b"].ema_signal == 0
