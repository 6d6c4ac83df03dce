"""Linear families as tables: fits from running sums, stored coefficients, forecasts by column expressions.

The structural family's normal equations at any origin follow from running sums of the products
of its columns, which one window pass gives for every period. A hinge that starts at period k is
also a difference of such sums (of i * f and f, up to the origin less up to k), so changepoints need no further pass.
What is left per (candidate, origin) is a small solve. Coefficients are rows of a table; forecasts are
made of them without Python.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandlake.config import BacktestConfig
from demandlake.models.solvers import autoregressive_fit
from demandlake.operators.rolling_origin import positions

WAVES = 3  # yearly orders that the running sums hold
CHANGEPOINTS = 8

KEYS = "sku string, family string, candidate_id string, cycle_index int, origin_date date, n_train bigint, mase_scale double, status string"
STRUCTURAL = (
    f"{KEYS}, scale double, level double, slope double, logarithm boolean, knots array<struct<at: double, value: double>>, "
    "waves array<struct<frequency: int, sine: double, cosine: double>>, drivers array<struct<name: string, center: double, spread: double, value: double>>"
)
AUTOREGRESSIVE = (
    f"{KEYS}, season int, constant double, lags array<struct<lag: int, value: double>>, shocks array<struct<lag: int, value: double>>, "
    "drivers array<struct<name: string, center: double, spread: double, value: double>>, past array<double>, errors array<double>, "
    "ends array<double>, seasons array<array<double>>, driver_tail array<array<double>>, order_d int, order_seasonal_d int"
)


def _names(schema: str) -> list[str]:
    return re.findall(r"(\w+) (?:string|int|bigint|date|double|boolean|array)\b", schema)


def running_sums(
    history: DataFrame, regressors: Sequence[str] = (), target: str = "monthly_demand", date: str = "month_start_date", season: int = 12
) -> DataFrame:
    """Per period: its number, and sums up to it of all products of the structural columns.

    ``sums`` holds the upper triangle, row by row, over 1, the period (from 0), sine and cosine of the year's first
    frequencies, the regressors, the target and its logarithm. Further sums serve the scale, the noise and
    the seasonal error. A null counts as 0 and is counted in ``nulls``: a fit up to there fails.
    """
    by = Window.partitionBy("sku").orderBy(date)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    log = F.log1p(F.greatest(y, F.lit(0.0)))
    missing = F.col(target).isNull()
    for r in regressors:
        missing = missing | F.col(r).isNull()
    angle = F.lit(2 * math.pi) * F.month(date) / 12
    base = [F.lit(1.0), (F.row_number().over(by) - 1).cast("double")]
    base += [f(angle * k) for k in range(1, WAVES + 1) for f in (F.sin, F.cos)]
    base += [F.coalesce(F.col(r).cast("double"), F.lit(0.0)) for r in regressors] + [y, log]
    wide = history.select(
        "sku", F.col(date).alias("date"), F.array(*base).alias("_z"), y.alias("_y"), log.alias("_l"), missing.cast("int").alias("_m"),
        (y - F.lag(y).over(by)).alias("_dy"), (log - F.lag(log).over(by)).alias("_dl"), F.abs(y - F.lag(y, season).over(by)).alias("_ds"),
    )
    upto = Window.partitionBy("sku").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z, total = F.col("_z"), lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0))
    sums = F.array(*[total(z[a] * z[b]) for a in range(len(base)) for b in range(a, len(base))])
    return wide.select(
        "sku", "date", F.row_number().over(Window.partitionBy("sku").orderBy("date")).alias("rn"), sums.alias("sums"),
        F.array(total(F.col("_dy")), total(F.col("_dy") ** 2), total(F.col("_dl")), total(F.col("_dl") ** 2)).alias("steps"),
        F.max(F.abs("_y")).over(upto).alias("top"), F.max("_l").over(upto).alias("log_top"), F.min("_y").over(upto).alias("low"),
        F.nullif(F.avg("_ds").over(upto), F.lit(0.0)).alias("mase_scale"), F.sum("_m").over(upto).alias("nulls"),
    )


def _knots(n: int, wanted: int) -> np.ndarray:
    count = min(wanted, n // 3)
    return np.linspace(1, max(int(0.8 * n) - 1, 1), count, dtype=int) if count else np.empty(0, int)


def _normal(sums: np.ndarray, n: int, knots: np.ndarray) -> np.ndarray:
    """Products, summed over the first n periods, of 1, i, the hinges and the other columns in turn."""
    full, width = sums[n - 1], sums.shape[1]
    late = full[:2] - sums[knots - 1][:, :2]  # of 1 and i with all columns, from each knot on
    hinge = late[:, 1] - knots[:, None] * late[:, 0]
    both = np.maximum(knots[:, None], knots[None, :])
    after = full[:2, :2] - sums[both - 1][:, :, :2, :2]
    cross = after[..., 1, 1] - (knots[:, None] + knots[None, :]) * after[..., 0, 1] + knots[:, None] * knots[None, :] * after[..., 0, 0]
    m = len(knots)
    out = np.zeros((width + m, width + m))
    rest = np.r_[0, 1, 2 + m : width + m]
    out[np.ix_(rest, rest)] = full
    out[2 : 2 + m, rest] = hinge
    out[rest, 2 : 2 + m] = hinge.T
    out[2 : 2 + m, 2 : 2 + m] = cross
    return out


def _solve(sums: pd.DataFrame, grams: np.ndarray, n: int, params: dict, names: list[str]) -> dict:
    """Coefficients of one candidate from the sums up to period n, as solvers.structural fits them."""
    at, log = sums.iloc[n - 1], bool(params.get("multiplicative"))
    if n < 6:
        raise ValueError(f"structural fit needs 6 observations, has {n}")
    if at["nulls"]:
        raise ValueError("a value is missing")
    if log and at["low"] < 0:
        raise ValueError("the multiplicative mode needs non-negative demand")
    scale = float(at["log_top"] if log else at["top"]) or 1.0
    s, s2 = (at["steps"][2], at["steps"][3]) if log else (at["steps"][0], at["steps"][1])
    noise = max((s2 / (n - 1) - (s / (n - 1)) ** 2) / scale**2 / 2, 1e-6)
    knots = _knots(n, int(params.get("n_changepoints", CHANGEPOINTS)))
    order, m, r, length = int(params.get("yearly_order", 0)), len(knots), len(names), max(n - 1, 1)
    if order > WAVES:
        raise ValueError(f"the running sums hold {WAVES} yearly orders")
    gram = _normal(grams, n, knots)
    xs = np.arange(r) + 2 + m + 2 * WAVES
    used = np.r_[0 : 2 + m + 2 * order, xs].astype(int)
    center = gram[0, xs] / n
    square = gram[xs, xs] / n - center**2
    varied = square > 1e-12 * np.maximum(1.0, center**2)
    spread = np.where(varied, np.sqrt(np.maximum(square, 0.0)), 1.0)
    change = np.eye(len(gram))  # to the columns that are fitted: time from 0 to 1, standardised regressors
    change[np.arange(1, 2 + m), np.arange(1, 2 + m)] = 1 / length
    change[xs, xs] = varied / spread
    change[0, xs] = -center * varied / spread
    fitted = (change.T @ gram @ change)[np.ix_(used, used)]
    right = (change.T @ gram[:, -1 if log else -2])[used] / scale
    prior = [1e3, 5.0] + [float(params.get("changepoint_prior_scale", 0.05))] * m
    prior += [float(params.get("seasonality_prior_scale", 10.0))] * (2 * order) + [float(params.get("regressor_prior_scale", 1.0))] * r
    beta = np.linalg.solve(fitted + np.diag(noise / np.square(prior)), right)
    if not np.isfinite(beta).all():
        raise ValueError("coefficients are not finite")
    waves, drivers = beta[2 + m : 2 + m + 2 * order], beta[2 + m + 2 * order :]
    return {
        "scale": scale, "level": beta[0], "slope": beta[1], "logarithm": log,
        "knots": [{"at": k / length, "value": v} for k, v in zip(knots.tolist(), beta[2 : 2 + m].tolist(), strict=True)],
        "waves": [{"frequency": k + 1, "sine": waves[2 * k], "cosine": waves[2 * k + 1]} for k in range(order)],
        "drivers": [{"name": c, "center": a, "spread": b, "value": v} for c, a, b, v in zip(names, center.tolist(), spread.tolist(), (drivers * varied).tolist(), strict=True)],
    }


def fit_structural(
    sums: DataFrame, candidates: DataFrame, regressors: Sequence[str] = (), cfg: BacktestConfig | None = None
) -> DataFrame:
    """Coefficients of every (series, candidate) on the whole history, or at each origin of ``cfg``.

    ``sums`` comes from ``running_sums`` with the same regressors, ``candidates`` has (sku, family, candidate_id, params). A
    fit that fails keeps its row with the reason. The whole-history fit has cycle_index 0; with ``cfg``, a series
    shorter than its protocol needs gets no rows. Candidates with a column ``origins`` are fitted after each of
    these numbers of periods instead, which are then the cycle_index.
    """
    names, columns, own = list(regressors), _names(STRUCTURAL), "origins" in candidates.columns

    def run(hist: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        hist = hist.sort_values("rn")
        total, rows = len(hist), []
        if not total or (cfg and total < cfg.required_periods):
            return pd.DataFrame(rows, columns=columns)
        flat = np.array(hist["sums"].to_list(), float)
        width = int((math.isqrt(8 * flat.shape[1] + 1) - 1) // 2)
        grams, upper = np.zeros((total, width, width)), np.triu_indices(width)
        grams[:, upper[0], upper[1]] = flat
        grams[:, upper[1], upper[0]] = flat
        ends = {k: total - cfg.horizon - cfg.step * (cfg.n_cycles - k) for k in range(1, cfg.n_cycles + 1)} if cfg else {0: total}
        for c in cand.itertuples(index=False):
            for k, n in ({n: n for n in c.origins if 0 < n <= total} if own else ends).items():
                at = hist.iloc[n - 1]
                row = {"sku": c.sku, "family": c.family, "candidate_id": c.candidate_id, "cycle_index": k, "origin_date": at["date"], "n_train": n, "mase_scale": at["mase_scale"]}
                try:
                    row |= _solve(hist, grams, n, json.loads(c.params), names) | {"status": "success"}
                except Exception as exc:  # noqa: BLE001 - one failing fit must not end the others
                    row["status"] = f"failed: {exc}"
                rows.append(row)
        out = pd.DataFrame(rows, columns=columns)
        return out.astype(object).where(out.notna(), None)

    left = sums.withColumn("sku", F.col("sku").alias("sku")).repartition("sku").groupBy("sku")
    more = ["origins"] if own else []
    right = candidates.select(F.col("sku").alias("sku"), "family", "candidate_id", "params", *more).repartition("sku").groupBy("sku")
    return left.cogroup(right).applyInPandas(run, STRUCTURAL)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _driver_map(regressors: Sequence[str]) -> Column:
    pairs = [c for r in regressors for c in (F.lit(r), F.col(r).cast("double"))]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")


def structural_value(period: Column, month: Column, drivers: Column) -> Column:
    """Forecast of a stored structural fit for a period (from 0, counted from the series' start).

    ``drivers`` maps a regressor's name to its value; a regressor without a value gives null.
    """
    t = period / F.greatest(F.col("n_train") - 1, F.lit(1))
    angle = F.lit(2 * math.pi) * month / 12
    trend = F.col("level") + F.col("slope") * t + _total(F.transform("knots", lambda k: k["value"] * F.greatest(t - k["at"], F.lit(0.0))))
    year = _total(F.transform("waves", lambda w: w["sine"] * F.sin(angle * w["frequency"]) + w["cosine"] * F.cos(angle * w["frequency"])))
    driven = _total(F.transform("drivers", lambda d: d["value"] * (F.element_at(drivers, d["name"]) - d["center"]) / d["spread"]))
    value = F.col("scale") * (trend + year + driven)
    return F.when(F.col("logarithm"), F.expm1(value)).otherwise(value)


def backtest_structural(
    history: DataFrame, candidates: DataFrame, cfg: BacktestConfig | None = None, regressors: Sequence[str] = (),
    target: str = "monthly_demand", date: str = "month_start_date",
) -> DataFrame:
    """Predictions of structural candidates at every origin, in the columns of ``grouped.backtest`` without residuals.

    A target month with a missing regressor has no prediction and says so.
    History is read once for the sums and once for the targets, whatever the number of candidates.
    """
    cfg = cfg or BacktestConfig()
    fits = fit_structural(running_sums(history, regressors, target, date, cfg.season), candidates, regressors, cfg)
    rows = positions(history.select("sku", date, target, *regressors), date).withColumn(
        "cycle_index", F.explode(F.array(*[F.lit(k) for k in range(1, cfg.n_cycles + 1)]))
    )
    origin = F.col("_n") - cfg.horizon - cfg.step * (cfg.n_cycles - F.col("cycle_index"))
    step = (F.col("_rn") - origin).cast("int")
    ahead = rows.withColumn("horizon_step", step).filter(F.col("horizon_step").between(1, cfg.horizon)).select(
        "sku", "cycle_index", "horizon_step", F.col(date).alias("target_date"), F.col(target).alias("y_true"), _driver_map(regressors).alias("_x")
    )
    value = structural_value(F.col("n_train") - 1 + F.col("horizon_step"), F.month("target_date"), F.col("_x"))
    scored = fits.join(ahead, ["sku", "cycle_index"]).withColumn("y_pred", value)
    unknown = (F.col("status") == "success") & F.col("y_pred").isNull()
    return scored.select(
        "sku", "family", "candidate_id", "cycle_index", "origin_date", "horizon_step", "target_date", "y_true", "y_pred",
        "n_train", "mase_scale", F.when(unknown, "failed: a regressor is missing").otherwise(F.col("status")).alias("status"),
    )


def lead_time_predictions(
    history: DataFrame, candidates: DataFrame, leads: Sequence[int], window: int, regressors: Sequence[str] = (),
    target: str = "monthly_demand", date: str = "month_start_date",
) -> DataFrame:
    """Predictions of each of the last ``window`` periods by refits that end ``lead`` periods before it.

    The job list of (origin, target, lead) is sparse: an origin that several targets share is fitted once per
    candidate, others not at all. The columns of ``backtest_structural`` with lead_time for the step; a target
    whose origin lies before the series has no row.
    """
    rows = positions(history.select("sku", date, target, *regressors), date)
    late = rows.filter(F.col("_rn") > F.col("_n") - window).select(
        "sku", F.col("_rn").alias("_target"), F.explode(F.array(*[F.lit(int(k)) for k in leads])).alias("lead_time"), F.col(date).alias("target_date"),
        F.col(target).alias("y_true"), _driver_map(regressors).alias("_x"),
    )
    jobs = late.withColumn("cycle_index", (F.col("_target") - F.col("lead_time")).cast("int")).filter("cycle_index > 0")
    origins = jobs.groupBy("sku").agg(F.sort_array(F.collect_set("cycle_index")).alias("origins"))
    sums = running_sums(history, regressors, target, date)
    fits = fit_structural(sums, candidates.select("sku", "family", "candidate_id", "params").join(origins, "sku"), regressors)
    value = structural_value(F.col("_target") - 1, F.month("target_date"), F.col("_x"))
    scored = fits.join(jobs, ["sku", "cycle_index"]).withColumn("y_pred", value)
    unknown = (F.col("status") == "success") & F.col("y_pred").isNull()
    return scored.select(
        "sku", "family", "candidate_id", "cycle_index", "origin_date", "lead_time", "target_date", "y_true", "y_pred", "n_train", "mase_scale",
        F.when(unknown, "failed: a regressor is missing").otherwise(F.col("status")).alias("status"),
    )


def fit_autoregressive(
    history: DataFrame, candidates: DataFrame, regressors: Sequence[str] = (), target: str = "monthly_demand", date: str = "month_start_date"
) -> DataFrame:
    """Coefficients and last state of every (series, candidate) on the whole history.

    ``past`` and ``errors`` are the differenced values and shocks that the lags still reach, ``ends`` and ``seasons``
    what undoes the differences, ``driver_tail`` the regressor rows that the next differences need.
    """
    names, columns = list(regressors), _names(AUTOREGRESSIVE)

    def run(hist: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        hist, rows = hist.sort_values(date), []
        y, x = hist[target].to_numpy(float), hist[names].to_numpy(float)
        for c in cand.itertuples(index=False):
            row = {"sku": c.sku, "family": c.family, "candidate_id": c.candidate_id, "cycle_index": 0, "origin_date": hist[date].iloc[-1] if len(hist) else None, "n_train": len(y)}
            try:
                if not (np.isfinite(y).all() and np.isfinite(x).all()):
                    raise ValueError("a value is missing")
                fit = autoregressive_fit(y, x, json.loads(c.params))
                n, d, sd, s = len(y), fit.d, fit.seasonal_d, fit.season
                reach = max([1, *fit.lags, *fit.shocks])
                parts = np.split(fit.beta, np.cumsum([len(fit.lags), len(fit.shocks), len(names)]))
                pairs = lambda lags, values: [{"lag": a, "value": b} for a, b in zip(lags, values.tolist(), strict=True)]
                row |= {
                    "status": "success", "season": s, "constant": float(parts[3].sum()), "lags": pairs(fit.lags, parts[0]), "shocks": pairs(fit.shocks, parts[1]),
                    "drivers": [{"name": a, "center": 0.0, "spread": 1.0, "value": b} for a, b in zip(names, parts[2].tolist(), strict=True)],
                    "past": fit.levels[-1][-reach:].tolist(), "errors": fit.errors[-reach:].tolist(),
                    "ends": [float(fit.levels[-2 - i][-1]) for i in range(d)], "seasons": [fit.levels[sd - 1 - i][-s:].tolist() for i in range(sd)],
                    "driver_tail": x[n - d - s * sd :].tolist(), "order_d": d, "order_seasonal_d": sd,
                }
            except Exception as exc:  # noqa: BLE001 - reported per series
                row["status"] = f"failed: {exc}"
            rows.append(row)
        out = pd.DataFrame(rows, columns=columns)
        return out.astype(object).where(out.notna(), None)

    left = history.select(F.col("sku").alias("sku"), date, target, *names).repartition("sku").groupBy("sku")
    right = candidates.select(F.col("sku").alias("sku"), "family", "candidate_id", "params").repartition("sku").groupBy("sku")
    return left.cogroup(right).applyInPandas(run, AUTOREGRESSIVE)


def _last(values: Column, back: Column) -> Column:
    return F.try_element_at(values, (-back).cast("int"))


def autoregressive_path(ahead: Column, most_d: int = 2, most_seasonal_d: int = 1) -> Column:
    """Forecasts of a stored autoregressive fit for the next periods, as an array.

    ``ahead`` holds an array of regressor values, in the order of ``drivers``, per period.
    """
    horizon = F.size(ahead)
    rows = F.concat("driver_tail", ahead)
    lagged = lambda a, n: F.transform(
        F.sequence(F.lit(1), F.size(a) - n), lambda i: F.zip_with(F.element_at(a, i + n), F.element_at(a, i), lambda p, q: p - q)
    )
    for k in range(most_seasonal_d):
        rows = F.when(F.col("order_seasonal_d") > k, lagged(rows, F.col("season"))).otherwise(rows)
    for k in range(most_d):
        rows = F.when(F.col("order_d") > k, lagged(rows, F.lit(1))).otherwise(rows)
    coefficients = F.transform("drivers", lambda d: d["value"])
    driven = F.transform(rows, lambda r: _total(F.zip_with(r, coefficients, lambda a, b: a * b)))

    def advance(state: Column, push: Column) -> Column:
        value = F.col("constant") + push + _total(F.transform("lags", lambda c: c["value"] * _last(state["past"], c["lag"])))
        value = value + _total(F.transform("shocks", lambda c: c["value"] * _last(state["errors"], c["lag"])))
        return F.struct(F.concat(state["past"], F.array(value)).alias("past"), F.concat(state["errors"], F.array(F.lit(0.0))).alias("errors"))

    start = F.struct(F.col("past").alias("past"), F.col("errors").alias("errors"))
    path = F.aggregate(driven, start, advance, lambda s: F.slice(s["past"], F.size("past") + 1, horizon))
    for k in range(most_d):
        end = F.array(F.try_element_at("ends", F.lit(k + 1)))
        summed = F.aggregate(path, end, lambda a, v: F.concat(a, F.array(v + _last(a, F.lit(1)))), lambda a: F.slice(a, F.lit(2), horizon))
        path = F.when(F.col("order_d") > k, summed).otherwise(path)
    for k in range(most_seasonal_d):
        season = F.try_element_at("seasons", F.lit(k + 1))
        summed = F.aggregate(path, season, lambda a, v: F.concat(a, F.array(v + _last(a, F.col("season")))), lambda a: F.slice(a, F.col("season") + 1, horizon))
        path = F.when(F.col("order_seasonal_d") > k, summed).otherwise(path)
    return path


def save(fits: DataFrame, path: str) -> None:
    """Write fits to the coefficient store, a partition per family; a family's earlier fits there are replaced."""
    fits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("family").parquet(path)


def load(spark: SparkSession, path: str, family: str) -> DataFrame:
    """Fits of one family from the coefficient store; only its partition is read."""
    schema = STRUCTURAL if family == "structural" else AUTOREGRESSIVE
    return spark.read.schema(schema).parquet(path).filter(F.col("family") == family)


def terms(fits: DataFrame) -> DataFrame:
    """(sku, family, candidate_id, term, value): coefficients of structural or autoregressive fits, a row each."""
    def entry(name: Column | str, value: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("term"), value.alias("value"))

    def numbered(name: str, column: str, field: str, value: str = "value") -> Column:
        return F.transform(column, lambda c: entry(F.concat(F.lit(name), c[field].cast("string")), c[value]))

    parts = [F.transform("drivers", lambda d: entry(d["name"], d["value"]))]
    if "knots" in fits.columns:
        parts += [F.array(entry("level", F.col("level")), entry("slope", F.col("slope")))]
        parts += [F.transform("knots", lambda k, i: entry(F.concat(F.lit("knot_"), (i + 1).cast("string")), k["value"]))]
        parts += [numbered("sine_", "waves", "frequency", "sine"), numbered("cosine_", "waves", "frequency", "cosine")]
    else:
        parts += [F.array(entry("constant", F.col("constant"))), numbered("lag_", "lags", "lag"), numbered("shock_", "shocks", "lag")]
    good = fits.filter("status = 'success'")
    return good.select("sku", "family", "candidate_id", F.inline(F.concat(*parts)))


def forecast(fits: DataFrame, future: DataFrame, regressors: Sequence[str] = (), date: str = "month_start_date") -> DataFrame:
    """Forecasts of stored fits of one family for the future rows (sku, date, regressors) of each series.

    (sku, family, candidate_id, date, horizon, forecast, status) as ``grouped.forecast`` gives them; a failed fit has null forecasts.
    """
    keys = ["sku", "family", "candidate_id"]
    if "knots" in fits.columns:
        step = F.row_number().over(Window.partitionBy("sku").orderBy(date))
        ahead = future.select("sku", F.col(date).alias("date"), step.alias("horizon"), _driver_map(regressors).alias("_x"))
        value = structural_value(F.col("n_train") - 1 + F.col("horizon"), F.month("date"), F.col("_x"))
        return fits.join(ahead, "sku").select(*keys, "date", "horizon", value.alias("forecast"), "status")
    row = F.struct(F.col(date).alias("date"), F.array(*[F.col(r).cast("double") for r in regressors]).cast("array<double>").alias("x"))
    ahead = future.groupBy("sku").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    path = F.when(F.col("status") == "success", autoregressive_path(F.transform("_rows", lambda r: r["x"])))
    found = fits.join(ahead, "sku").withColumn("_path", path).select(*keys, "status", "_path", F.posexplode("_rows").alias("_pos", "_row"))
    return found.select(*keys, F.col("_row.date").alias("date"), (F.col("_pos") + 1).alias("horizon"), F.get("_path", F.col("_pos")).alias("forecast"), "status")
