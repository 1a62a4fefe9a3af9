"""One-series forecasters in numpy: naive, drift, damped Holt, small ARIMA models and a blend."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MODELS = ["naive", "drift", "holt_damped", "arima_011", "arima_110", "arima_111", "blend_naive_arima110"]


def _minimise(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Pattern search inside a box: try each direction, halve the steps when none helps."""
    at, step, best = start.copy(), (high - low) / 4, f(start)
    for _ in range(rounds):
        moved = False
        for k in range(len(at)):
            for sign in (1, -1):
                to = at.copy()
                to[k] = np.clip(at[k] + sign * step[k], low[k], high[k])
                value = f(to)
                if value < best:
                    at, best, moved = to, value, True
                    break
        if not moved:
            step = step / 2
            if (step < 1e-6 * (high - low)).all():
                break
    return at


def _holt(y: np.ndarray, alpha: float, beta: float, phi: float) -> tuple[np.ndarray, float, float]:
    """One-step errors, last level and trend of additive damped Holt smoothing."""
    level, trend = y[0], y[1] - y[0]
    err = np.empty(len(y) - 1)
    for t in range(1, len(y)):
        ahead = level + phi * trend
        err[t - 1] = y[t] - ahead
        new = ahead + alpha * err[t - 1]
        trend = phi * trend + alpha * beta * err[t - 1]
        level = new
    return err, level, trend


def _arma(d: np.ndarray, ar: float, ma: float) -> np.ndarray:
    """Errors of an ARMA(1, 1) of differences, from a first error of the first difference."""
    err = np.empty(len(d))
    before, last = 0.0, 0.0
    for t, x in enumerate(d):
        err[t] = x - ar * before - ma * last
        before, last = x, err[t]
    return err


def fit_forecast(name: str, y: np.ndarray, horizon: int) -> tuple[np.ndarray, float]:
    """Forecast of the next values, and the standard deviation of the one-step errors (1 without two of them)."""
    steps, diffs = np.arange(1, horizon + 1), np.diff(y)
    spread = lambda e: float(np.std(e, ddof=1)) if len(e) > 1 else 1.0
    if name == "naive" or len(y) < 4:
        return np.repeat(y[-1], horizon), spread(diffs)
    if name == "drift":
        return y[-1] + (y[-1] - y[0]) / (len(y) - 1) * steps, spread(diffs)
    if name == "holt_damped":
        low, high = np.array([1e-3, 1e-4, 0.8]), np.array([0.999, 0.999, 0.995])
        best = _minimise(lambda p: float((_holt(y, *p)[0] ** 2).sum()), np.array([0.8, 0.1, 0.95]), low, high)
        err, level, trend = _holt(y, *best)
        return level + trend * np.cumsum(best[2] ** steps), spread(err)
    if name == "blend_naive_arima110":
        path, _ = fit_forecast("arima_110", y, horizon)
        ar = _ar_coefficient(diffs)
        inside = y[:-1] + 0.25 * ar * np.concatenate(([0.0], diffs[:-1]))
        return 0.25 * path + 0.75 * y[-1], spread(y[1:] - inside)
    if name == "arima_110":
        ar, ma = _ar_coefficient(diffs), 0.0
    elif name == "arima_011":
        ar, ma = 0.0, float(_minimise(lambda p: float((_arma(diffs, 0.0, p[0]) ** 2).sum()), np.zeros(1), np.array([-0.98]), np.array([0.98]))[0])
    elif name == "arima_111":
        ar, ma = _minimise(lambda p: float((_arma(diffs, p[0], p[1]) ** 2).sum()), np.zeros(2), np.full(2, -0.98), np.full(2, 0.98))
    else:
        raise ValueError(f"no model is named {name!r}")
    err = _arma(diffs, ar, ma)
    first = ar * diffs[-1] + ma * err[-1]
    return y[-1] + np.cumsum(first * ar ** (steps - 1)) if ar else y[-1] + np.repeat(first, horizon), spread(err)


def _ar_coefficient(diffs: np.ndarray) -> float:
    below = float((diffs[:-1] ** 2).sum())
    return float((diffs[1:] * diffs[:-1]).sum() / below) if below > 0 else 0.0
