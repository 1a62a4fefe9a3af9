"""Technical indicators of many series: averages, momentum, RSI, MACD, ranges and their ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.recursive import Difference, averaged, averaged_in_chunks, span, wilder
from tidemark.operators.chunks import ROWS, in_chunks
from tidemark.operators.features import by_row, change, last, rolling

WINDOWS = [5, 10, 20, 30, 50, 100]
RETURNS = [1, 3, 5, 10, 20]
RSI_PERIODS = [7, 14, 21]
RANGES = [10, 20, 30]


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0.0))


def relative_strength(gain: Column, loss: Column) -> Column:
    """RSI of the mean gain and loss: 100 without losses, 0 without gains, null on a flat stretch."""
    some = 100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))
    return F.when((loss == 0) & (gain > 0), 100.0).when((gain == 0) & (loss > 0), 0.0).otherwise(some)


def with_moves(series: DataFrame) -> DataFrame:
    """Add delta to the row before, and its gain and loss."""
    delta = F.col("value") - F.lag("value").over(by_row())
    return series.withColumn("delta", delta).withColumns(
        {"gain": F.when(F.col("delta").isNotNull(), F.greatest("delta", F.lit(0.0))), "loss": F.when(F.col("delta").isNotNull(), F.greatest(-F.col("delta"), F.lit(0.0)))}
    )


def with_averages(series: DataFrame, rows: int | None = None) -> DataFrame:
    """Add ema_*, macd, macd_signal, macd_hist and rsi_*.

    One grouped call to Python makes all recursive columns of a series; where rows is given, a series goes by chunks of so many rows instead.
    """
    moved = in_chunks(series, with_moves, 1, rows=rows) if rows else with_moves(series)
    first = [span(f"ema_{k}", "value", k) for k in sorted({*WINDOWS, 12, 26})]
    first += [wilder(f"{kind}_{p}", kind, p) for p in RSI_PERIODS for kind in ("gain", "loss")]
    # The signal line averages a difference of averages, so the grouped call makes that column on its way.
    columns = [*first, Difference("macd", "ema_12", "ema_26"), span("macd_signal", "macd", 9)]
    smooth = averaged_in_chunks(moved, columns, rows) if rows else averaged(moved, columns)
    rsi = {f"rsi_{p}": relative_strength(F.col(f"gain_{p}"), F.col(f"loss_{p}")) for p in RSI_PERIODS}
    drop = ["delta", "gain", "loss", "ema_12", "ema_26", *[f"{kind}_{p}" for p in RSI_PERIODS for kind in ("gain", "loss")]]
    return smooth.withColumns({**rsi, "macd_hist": F.col("macd") - F.col("macd_signal")}).drop(*drop)


def with_indicators(series: DataFrame) -> DataFrame:
    """series (series_id, date, row, value) with every indicator; each looks back only.  For series of days; see with_long_indicators."""
    return _with_windows(with_averages(series.withColumns({f"ret_{k}": change(k) for k in RETURNS})))


def with_long_indicators(series: DataFrame, rows: int = ROWS) -> DataFrame:
    """The same of series of any length (row from with_long_position), by chunks of rows."""
    moved = in_chunks(series, lambda s: s.withColumns({f"ret_{k}": change(k) for k in RETURNS}), max(RETURNS), rows=rows)
    return in_chunks(with_averages(moved, rows), _with_windows, max(WINDOWS), rows=rows)


def _with_windows(out: DataFrame) -> DataFrame:
    out = out.withColumns(
        {
            **{f"ma_{k}": rolling(F.avg("value").over(last(k)), k) for k in WINDOWS},
            **{f"vol_{k}": rolling(F.stddev_samp("ret_1").over(last(k)), k, k) for k in WINDOWS},
            **{f"high_{k}": rolling(F.max("value").over(last(k)), k) for k in RANGES},
            **{f"low_{k}": rolling(F.min("value").over(last(k)), k) for k in RANGES},
        }
    )
    return out.withColumns(
        {
            "range_pos_20": (F.col("value") - F.col("low_20")) / F.nullif(F.col("high_20") - F.col("low_20"), F.lit(0.0)),
            "ma_gap_5_20": _ratio("ma_5", "ma_20") - 1,
            "ma_gap_10_30": _ratio("ma_10", "ma_30") - 1,
            "ema_gap_20_50": _ratio("ema_20", "ema_50") - 1,
            "ema_slope_20": change(5, "ema_20"),
            "vol_ratio_10_30": _ratio("vol_10", "vol_30"),
        }
    )


def feature_vector(fast: int, slow: int, rsi_period: int) -> list[Column]:
    """The normalised state of a row, for a choice of averages."""
    return [
        (_ratio(f"ema_{fast}", f"ema_{slow}") - 1).alias("trend"),
        F.col("ret_10").alias("momentum_10"),
        F.col("ret_20").alias("momentum_20"),
        F.col(f"rsi_{rsi_period}").alias("rsi"),
        _ratio("macd", "value").alias("macd_norm"),
        _ratio("macd_hist", "value").alias("macd_hist_norm"),
        F.col("range_pos_20").alias("range_pos"),
        F.col("vol_20").alias("vol"),
    ]
