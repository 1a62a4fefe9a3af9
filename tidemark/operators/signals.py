"""Signals of +1, 0 or -1 from indicators, for one rule or for all candidate rules at once."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.staging import spread

#: The grid of candidate rules.
FAST, SLOW = [5, 10, 20], [30, 50, 100]
RSI, MOMENTUM = [7, 14, 21], [5, 10, 20]
BULL, BEAR = [55.0, 60.0], [45.0, 40.0]
MA_BANDS, BANDS, THRESHOLDS = [0.001, 0.003, 0.005], [0.001, 0.003], [2, 3]
STRATEGIES = ["ma", "ma_rsi", "trend_momentum", "combo"]
PARAMETERS = "candidate int, strategy string, fast int, slow int, rsi_period int, mom_window int, rsi_bull double, rsi_bear double, neutral_band double, score_threshold int"


def gap(fast: int, slow: int) -> Column:
    return F.col(f"ema_{fast}") / F.nullif(F.col(f"ema_{slow}"), F.lit(0.0)) - 1


def _side(up: Column, down: Column) -> Column:
    """1 where up holds, -1 where down holds, else (nulls too) 0."""
    return F.when(up, 1).when(down, -1).otherwise(0)


def ma(g: Column, band: Column) -> Column:
    return _side(g > band, g < -band)


def ma_rsi(g: Column, rsi: Column, band: Column, bull: Column, bear: Column) -> Column:
    return _side((g > band) & (rsi >= bull), (g < -band) & (rsi <= bear))


def trend_momentum(g: Column, momentum: Column, band: Column) -> Column:
    return _side((g > band) & (momentum > 0), (g < -band) & (momentum < 0))


def combo(g: Column, momentum: Column, rsi: Column, hist: Column, bull: Column, bear: Column, threshold: Column, strict: bool = False) -> Column:
    """Four votes against a threshold.  A null input votes 0, but a null gap (strict: any null) silences the rule."""
    votes = _side(g > 0, g < 0) + _side(momentum > 0, momentum < 0) + _side(rsi >= bull, rsi <= bear) + _side(hist > 0, hist < 0)
    there = reduce(lambda a, b: a & b, [c.isNotNull() for c in ((g, momentum, rsi, hist) if strict else (g,))])
    return F.when(there, _side(votes >= threshold, votes <= -threshold)).otherwise(0)


def signal(strategy: str, strict: bool = False, **p) -> Column:
    """The signal of one rule with its parameters; raises ValueError for a name that is no rule."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy is named {strategy!r}")
    g = gap(p["fast"], p["slow"])
    lit = {k: F.lit(v) for k, v in p.items()}
    if strategy == "ma":
        return ma(g, lit["neutral_band"])
    if strategy == "ma_rsi":
        return ma_rsi(g, F.col(f"rsi_{p['rsi_period']}"), lit["neutral_band"], lit["rsi_bull"], lit["rsi_bear"])
    if strategy == "trend_momentum":
        return trend_momentum(g, F.col(f"ret_{p['mom_window']}"), lit["neutral_band"])
    return combo(g, F.col(f"ret_{p['mom_window']}"), F.col(f"rsi_{p['rsi_period']}"), F.col("macd_hist"), lit["rsi_bull"], lit["rsi_bear"], lit["score_threshold"], strict)


def _grid() -> list[tuple]:
    pairs = [(f, s) for f, s in product(FAST, SLOW) if f < s]
    rows = [("ma", f, s, None, None, None, None, b, None) for (f, s), b in product(pairs, MA_BANDS)]
    rows += [("ma_rsi", f, s, r, None, u, d, b, None) for (f, s), r, u, d, b in product(pairs, RSI, BULL, BEAR, BANDS)]
    rows += [("trend_momentum", f, s, None, m, None, None, b, None) for (f, s), m, b in product(pairs, MOMENTUM, BANDS)]
    rows += [("combo", f, s, r, m, u, d, None, t) for (f, s), r, m, u, d, t in product(pairs, RSI, MOMENTUM, BULL, BEAR, THRESHOLDS)]
    return [(k + 1, *r) for k, r in enumerate(rows)]


def candidates(spark: SparkSession) -> DataFrame:
    """All 945 candidate rules with their parameters."""
    return spark.createDataFrame(_grid(), PARAMETERS)


#: Fixed value: the sample's seed, before the horizon is added.  Draws go family by family in the order of names, then to all that are left.
SAMPLE_SEED = 20261004


def sampled_candidates(spark: SparkSession, limit: int, horizon: int) -> DataFrame:
    """A stratified, seeded sample of the rules: a quarter of limit from each family, the rest from the rules that are then left.

    Numbers are drawn on the driver, as the grid is 945 rows by construction; the rules are looked up by number.
    """
    family = np.array([rule[1] for rule in _grid()])
    free, rng = np.ones(len(family), bool), np.random.default_rng(SAMPLE_SEED + horizon)

    def draw(pool: np.ndarray, size: int) -> None:
        free[pool[rng.choice(len(pool), size=size, replace=False)]] = False

    if limit < len(family):
        for name in sorted(STRATEGIES):
            own = np.flatnonzero(family == name)
            draw(own, min(len(own), max(limit // 4, 1)))
        if (missing := limit - np.count_nonzero(~free)) > 0:
            draw(np.flatnonzero(free), missing)
    else:
        free[:] = False
    return candidates(spark).where(F.col("candidate").isin((np.flatnonzero(~free) + 1).tolist()))


def _chosen(prefix: str, by: str, windows: list[int]) -> Column:
    """The indicator that a candidate names."""
    return reduce(lambda c, w: c.when(F.col(by) == w, F.col(f"{prefix}_{w}")), windows[1:], F.when(F.col(by) == windows[0], F.col(f"{prefix}_{windows[0]}")))


def candidate_signals(indicators: DataFrame, rules: DataFrame) -> DataFrame:
    """The signal of every rule on every row: series_id, row, date, value, candidate, strategy, signal.

    rules is a grid of at most 945 rows, so it is broadcast.  Rows are dealt over all tasks first, as each becomes as many rows
    as there are rules.
    """
    rows = spread(indicators.select("series_id", "row", "date", "value", *INPUTS), "series_id", "row")
    return with_signals(rows.crossJoin(F.broadcast(rules))).select("series_id", "row", "date", "value", "candidate", "strategy", "signal")


#: Indicators that rules name.
INPUTS = [*[f"ema_{k}" for k in (*FAST, *SLOW)], *[f"rsi_{k}" for k in RSI], *[f"ret_{k}" for k in MOMENTUM], "macd_hist"]


def with_signals(crossed: DataFrame) -> DataFrame:
    """Rows of indicators, each beside a rule, with the rule's signal.  The inputs that a rule names become columns, so that none is worked out twice."""
    inputs = {
        "gap": _chosen("ema", "fast", FAST) / F.nullif(_chosen("ema", "slow", SLOW), F.lit(0.0)) - 1,
        "rsi": _chosen("rsi", "rsi_period", RSI),
        "momentum": _chosen("ret", "mom_window", MOMENTUM),
    }
    g, rsi, momentum, band, bull, bear, threshold = (F.col(c) for c in (*inputs, "neutral_band", "rsi_bull", "rsi_bear", "score_threshold"))
    by_rule = (
        F.when(F.col("strategy") == "ma", ma(g, band))
        .when(F.col("strategy") == "ma_rsi", ma_rsi(g, rsi, band, bull, bear))
        .when(F.col("strategy") == "trend_momentum", trend_momentum(g, momentum, band))
        .when(F.col("strategy") == "combo", combo(g, momentum, rsi, F.col("macd_hist"), bull, bear, threshold))
        .otherwise(F.raise_error(F.concat(F.lit("no strategy is named "), F.col("strategy"))))
    )
    return crossed.withColumns(inputs).withColumn("signal", by_rule.cast("int")).drop(*inputs)
