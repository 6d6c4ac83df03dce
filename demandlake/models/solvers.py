"""Small dense fits used inside grouped tasks: one series, one candidate, one origin.

A forecaster takes the training target, its regressors and month numbers, the same for
the periods to forecast, and the candidate's parameters; it returns the forecasts and
the in-sample residuals. It raises ValueError when the series cannot carry the fit.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np


def _ridge(a: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a.T @ a + np.diag(penalty), a.T @ y)


def _standardise(x: np.ndarray, xf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    return (x - mean) / sd, (xf - mean) / sd


def _structural_fit(y, x, month, xf, monthf, params):
    """Design of all rows, coefficients on the scaled target, the scale, and where regressors start."""
    n, h = len(y), len(monthf)
    if n < 6:
        raise ValueError(f"structural fit needs 6 observations, has {n}")
    scale = np.abs(y).max() or 1.0
    target = y / scale
    noise = max(np.var(np.diff(target)) / 2, 1e-6)
    t = np.arange(n + h) / max(n - 1, 1)
    n_cp = int(min(params.get("n_changepoints", 8), n // 3))
    knots = t[np.linspace(1, max(int(0.8 * n) - 1, 1), n_cp, dtype=int)] if n_cp else np.empty(0)
    blocks = [np.ones((n + h, 1)), t[:, None]]
    prior = [1e3, 5.0]
    if n_cp:
        blocks.append(np.maximum(t[:, None] - knots[None, :], 0.0))
        prior += [float(params.get("changepoint_prior_scale", 0.05))] * n_cp
    order = int(params.get("yearly_order", 0))
    if order:
        angle = 2 * np.pi * np.concatenate([month, monthf]) / 12
        waves = [f(k * angle) for k in range(1, order + 1) for f in (np.sin, np.cos)]
        blocks.append(np.stack(waves, axis=1))
        prior += [float(params.get("seasonality_prior_scale", 10.0))] * (2 * order)
    first = len(prior)
    if x.shape[1]:
        xs, xfs = _standardise(x, xf)
        blocks.append(np.concatenate([xs, xfs]))
        prior += [float(params.get("regressor_prior_scale", 1.0))] * x.shape[1]
    a = np.concatenate(blocks, axis=1)
    return a, _ridge(a[:n], target, noise / np.square(prior)), scale, first


def structural(y, x, month, xf, monthf, params):
    """Piecewise-linear trend, optional yearly terms and shrunk regressors, as one ridge fit.

    A prior scale s of a coefficient group becomes the penalty noise / s^2 on the target
    scaled to its largest value; the noise level comes from the first differences. The
    multiplicative mode is the same fit on the logarithm.
    """
    if params.get("multiplicative"):
        if np.min(y) < 0:
            raise ValueError("the multiplicative mode needs non-negative demand")
        pred, resid = structural(np.log1p(y), x, month, xf, monthf, {**params, "multiplicative": 0})
        return np.expm1(pred), y - np.expm1(np.log1p(y) - resid)
    n = len(y)
    a, beta, scale, _ = _structural_fit(y, x, month, xf, monthf, params)
    fitted = a @ beta * scale
    return fitted[n:], y - fitted[:n]


def structural_contributions(y, x, month, params) -> np.ndarray:
    """Contribution of every regressor to every fitted value, in units of demand."""
    a, beta, scale, first = _structural_fit(y, x, month, x[:0], month[:0], params)
    return a[:, first:] * beta[first:] * scale


def _difference(z: np.ndarray, d: int, big_d: int, s: int) -> list[np.ndarray]:
    levels = [z]
    for _ in range(big_d):
        levels.append(levels[-1][s:] - levels[-1][:-s])
    for _ in range(d):
        levels.append(np.diff(levels[-1], axis=0))
    return levels


def _undifference(f: np.ndarray, levels: list[np.ndarray], d: int, big_d: int, s: int) -> np.ndarray:
    depth = len(levels) - 1
    for i in range(d):
        f = levels[depth - 1 - i][-1] + np.cumsum(f)
    for i in range(big_d):
        history = list(levels[big_d - 1 - i])
        for value in f:
            history.append(value + history[-s])
        f = np.array(history[-len(f):])
    return f


class AutoregressiveFit(NamedTuple):
    """What a fit leaves for forecasts: orders, coefficients (lags, shocks, drivers, constant), levels of differences, shocks."""

    d: int
    seasonal_d: int
    season: int
    lags: list[int]
    shocks: list[int]
    constant: int
    beta: np.ndarray
    levels: list[np.ndarray]
    errors: np.ndarray
    residuals: np.ndarray


def autoregressive_fit(y, x, params) -> AutoregressiveFit:
    """Seasonal autoregression with moving-average terms and drivers, by conditional least squares.

    Orders p, d, q and P, D, Q with season s. Past shocks are the residuals of a long
    autoregression (Hannan and Rissanen, 1982).
    """
    p, d, q = (int(params.get(k, 0)) for k in ("p", "d", "q"))
    sp, sd, sq = (int(params.get(k, 0)) for k in ("P", "D", "Q"))
    s = int(params.get("s", 12))
    if len(y) <= s * sd + d + 3:
        raise ValueError(f"{len(y)} observations are too few for the differences")
    levels = _difference(np.asarray(y, dtype=float), d, sd, s)
    w = levels[-1]
    n = len(w)
    drivers = _difference(x, d, sd, s)[-1] if x.shape[1] else np.empty((n, 0))
    lags = list(range(1, p + 1)) + [s * k for k in range(1, sp + 1)]
    shocks = list(range(1, q + 1)) + [s * k for k in range(1, sq + 1)]
    eps, start = np.zeros(n), 0
    if shocks:
        long = min(max(int(math.log(n) ** 1.5), 1), n // 3)
        design = np.stack([w[long - k: n - k] for k in range(1, long + 1)], axis=1)
        eps[long:] = w[long:] - design @ _ridge(design, w[long:], np.full(long, 1e-6 * max(np.var(w), 1e-12) * n))
        start = long
    start = max([start, *lags, *shocks])
    const = int(params.get("trend", 0))
    width = len(lags) + len(shocks) + drivers.shape[1] + const
    if n - start < width + 3:
        raise ValueError(f"{n - start} usable rows are too few for {width} coefficients")
    cols = [w[start - k: n - k] for k in lags] + [eps[start - k: n - k] for k in shocks]
    cols += [drivers[start:n, j] for j in range(drivers.shape[1])] + ([np.ones(n - start)] if const else [])
    if cols:
        a = np.stack(cols, axis=1)
        size = np.maximum(np.square(a).sum(axis=0), 1e-12)
        beta = _ridge(a, w[start:], 1e-3 * size)
        resid = w[start:] - a @ beta
    else:
        beta, resid = np.empty(0), w[start:].copy()
    return AutoregressiveFit(d, sd, s, lags, shocks, const, beta, levels, eps, resid)


def autoregressive(y, x, month, xf, monthf, params):
    """Forecasts and residuals of ``autoregressive_fit``."""
    fit, h = autoregressive_fit(y, x, params), len(monthf)
    n = len(fit.levels[-1])
    ahead = _difference(np.concatenate([x, xf]), fit.d, fit.seasonal_d, fit.season)[-1][n:] if x.shape[1] else np.empty((h, 0))
    past, shock, out = list(fit.levels[-1]), list(fit.errors), []
    for i in range(h):
        row = [past[-k] for k in fit.lags] + [shock[-k] for k in fit.shocks] + list(ahead[i]) + [1.0] * fit.constant
        value = float(np.dot(fit.beta, row)) if row else 0.0
        out.append(value)
        past.append(value)
        shock.append(0.0)
    return _undifference(np.array(out), fit.levels, fit.d, fit.seasonal_d, fit.season), fit.residuals


def regression_terms(y: np.ndarray, x: np.ndarray):
    """OLS coefficients with standard errors and two-sided normal p-values (intercept left out).

    Columns without variation, or that others already span, get nulls.
    """
    n, k = x.shape
    varied = [j for j in range(k) if x[:, j].std() > 0]
    a = np.concatenate([np.ones((n, 1)), x[:, varied]], axis=1)
    coef, se, p = (np.full(k, np.nan) for _ in range(3))
    if n <= a.shape[1] or np.linalg.matrix_rank(a) < a.shape[1]:
        return coef, se, p
    inv = np.linalg.inv(a.T @ a)
    beta = inv @ a.T @ y
    sigma2 = np.square(y - a @ beta).sum() / (n - a.shape[1])
    err = np.sqrt(np.diag(inv) * sigma2)
    for i, j in enumerate(varied, start=1):
        coef[j], se[j] = beta[i], err[i]
        if err[i] > 0:
            p[j] = math.erfc(abs(beta[i] / err[i]) / math.sqrt(2))
    return coef, se, p


def shrunk_covariance(e: np.ndarray) -> np.ndarray:
    """Covariance of residual rows with correlations shrunk towards 0 (Schaefer and Strimmer, 2005).

    Fewer than three rows give the diagonal only.
    """
    n, k = e.shape
    centred = e - e.mean(axis=0)
    var = np.square(centred).sum(axis=0) / max(n - 1, 1)
    var = np.where(var > 0, var, 1e-8 * max(var.max(initial=0.0), 1.0))
    if n < 3 or k == 1:
        return np.diag(var)
    z = centred / np.sqrt(var)
    r = z.T @ z / (n - 1)
    prod = z[:, :, None] * z[:, None, :]
    spread = np.square(prod - prod.mean(axis=0)).sum(axis=0) * n / (n - 1) ** 3
    off = ~np.eye(k, dtype=bool)
    total = np.square(r[off]).sum()
    lam = float(np.clip(spread[off].sum() / total, 0.0, 1.0)) if total > 0 else 1.0
    r = np.where(off, (1 - lam) * r, 1.0)
    sd = np.sqrt(var)
    return r * np.outer(sd, sd)


FORECASTERS = {"structural": structural, "autoregressive": autoregressive}
